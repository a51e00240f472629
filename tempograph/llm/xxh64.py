"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# Fixed values of the published XXH64 specification.
P1, P2, P3, P4, P5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)
LONG = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(words: np.ndarray, data: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of data[a:a+n] for each a; words[i] holds the 8 bytes from i on."""
    s, done = U(seed), 0
    if n >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        while done + 32 <= n:
            v = [_round(v[i], words[at + done + 8 * i]) for i in range(4)]
            done += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(U(0), x)) * P1 + P4
    else:
        h = np.full(len(at), s + P5, np.uint64)
    h += U(n)
    while done + 8 <= n:
        h = _rotl(h ^ _round(U(0), words[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= n:
        h = _rotl(h ^ ((words[at + done] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
        done += 4
    while done < n:
        h = _rotl(h ^ (data[at + done].astype(np.uint64) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of data[starts[i]:ends[i]] for each i."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    words = np.empty(len(data) + 1, np.uint64)
    for r in range(8):
        lane = words[r::8]
        lane[:] = padded[r : r + 8 * len(lane)].view("<u8")
    lengths = ends - starts
    with np.errstate(over="ignore"):
        small = np.flatnonzero(lengths <= LONG)
        order = small[np.argsort(lengths[small].astype(np.uint16), kind="stable")]
        sizes, first = np.unique(lengths[order], return_index=True)
        for n, rows in zip(sizes, np.split(order, first[1:])):
            out[rows] = _same_length(words, padded, starts[rows], int(n), seed)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
