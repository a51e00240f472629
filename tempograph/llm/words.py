"""Vectorised word splitting and hashing over Arrow text columns.

Everything works on UTF-8 bytes of whole texts: no row is cut, and a batch is
walked in chunks of a quarter of a megabyte so memory does not follow the batch size.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Just under a power of two, to which tables of powers are rounded up.
CHUNK_BYTES = 250_000

_IDS = np.arange(256)
#: `[^\x20\x09-\x0D]+`
SPACED = ~((_IDS == 0x20) | ((_IDS >= 0x09) & (_IDS <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text whose A-Z are lower-cased
ALNUM = (_IDS >= 0x80) | ((_IDS >= 0x30) & (_IDS <= 0x39)) | ((_IDS >= 0x61) & (_IDS <= 0x7A))
LOWER = np.where((_IDS >= 0x41) & (_IDS <= 0x5A), _IDS + 32, _IDS).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Poly:
    """Polynomial hashing modulo 2**64 with an odd base, so that powers have inverses.

    Sequences of two symbols that collide for every base exist from about 2000
    symbols on, so `spans` is for short runs; see `placed`.
    """

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * self.base)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            self.up = np.concatenate([[U64(1)], np.cumprod(np.full(size, self.base))])
            self.down = np.concatenate([[U64(1)], np.cumprod(np.full(size, self.inverse))])
        return self.up, self.down

    def spans(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each [start, end) of a sequence of 64-bit symbols."""
        up, down = self.powers(len(symbols))
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def placed(symbols: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each [start, end): the sum of a value for each symbol at its place.

    Unlike a polynomial modulo a power of two it has no sequences that collide
    whatever the base; it needs places counted from each span's start.
    """
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols + place * U64(0xD1342543DE82EF95)), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


WORD, WORD2, GRAM, GRAM2 = Poly(0x9E3779B97F4A7C15), Poly(0xD6E8FEB86659FD93), Poly(0xC2B2AE3D27D4EB4F), Poly(0xA0761D6478BD642F)


@dataclass
class Words:
    """Words of rows lo..hi of a batch; word i has bytes data[starts[i]:ends[i]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray  #: byte offsets of the rows in data, hi - lo + 1 values
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: index of each row's first word, hi - lo + 1 values

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, poly: Poly = WORD) -> np.ndarray:
        """A hash of each word: the sum of one value for each byte and its place, so that no regular text collides."""
        sizes = self.ends - self.starts
        at = runs(self.starts, sizes)
        place = (at - np.repeat(self.starts, sizes)).astype(np.uint64)
        return placed(poly.values[self.data[at]], place, np.cumsum(sizes) - sizes, np.cumsum(sizes))

    def windows(self, width: int) -> np.ndarray:
        """Index of the first word of every run of `width` words inside one row."""
        n = self.counts
        return runs(self.first[:-1], np.maximum(n - width + 1, 0))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] values), starts[1], ..."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(column, kind: np.ndarray = SPACED, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a text column, chunk by chunk; every row lies in exactly one chunk."""
    offsets, data = text_bytes(column)
    for lo, hi in pieces(offsets, limit):
        part, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            part = LOWER[part]
        inside = kind[part]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        cuts = where[(where > 0) & (where < len(part))]
        begin[cuts] = inside[cuts]
        finish[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        yield Words(lo, hi, part, where, starts, ends, np.searchsorted(starts, where))


def member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted_keys, or -1; a table of low bits spares most searches."""
    found = np.full(len(values), -1, np.int64)
    if len(sorted_keys) == 0 or len(values) == 0:
        return found
    bits = U64((1 << max(16, int(len(sorted_keys)).bit_length() + 3)) - 1)
    seen = np.zeros(int(bits) + 1, bool)
    seen[(sorted_keys & bits).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values & bits).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_keys, values[maybe]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == values[maybe]
    found[maybe[hit]] = at[hit]
    return found
