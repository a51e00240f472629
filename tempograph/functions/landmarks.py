"""Which of a block's landmark prints may score in others, and the scores of many pairs at once.

A print is a sorted array of distinct hash << 32 | time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tempograph.functions import kernels

#: Hashes are numbered by these; landmark hashes have 512 * 127 * 63 values and get a number of their own each.
SLOTS = 1 << 22
#: Meetings of hashes counted, and entries and matches of pairs scored, in one go.
MEETINGS, ENTRIES = 1 << 20, 1 << 17
#: Pairs of more matches, or of later times, are scored one by one.
MATCHES, LATEST = 1 << 16, 1 << 20


def slots(h: np.ndarray) -> np.ndarray:
    """Hashes that share a number count as equal at first; scores look at the hashes."""
    return (((h >> 16) * 127 + ((h >> 8) & 0x7F)) * 63 + (h & 0x3F) - 1) & (SLOTS - 1)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _firsts(xs: np.ndarray) -> np.ndarray:
    new = np.ones(len(xs), bool)
    new[1:] = xs[1:] != xs[:-1]
    return np.flatnonzero(new)


class Prints:
    """Prints side by side: their ids and sides, ends[i] : ends[i + 1] of xs, and what follows from these."""

    def __init__(self, ids, sides: np.ndarray, sizes: np.ndarray, xs: np.ndarray):
        self.ids, self.sides, self.sizes, self.xs = ids, sides, sizes.astype(np.int64), xs
        self.ends = np.append(0, np.cumsum(self.sizes))
        self._found: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_found": {}}

    def _once(self, name: str, make):
        if name not in self._found:
            self._found[name] = make()
        return self._found[name]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def anchors(self) -> np.ndarray:
        """Distinct times of each print."""

        def make():
            key = np.sort(self.rows << 32 | self.xs & 0xFFFFFFFF)
            return np.bincount(key[_firsts(key)] >> 32, minlength=len(self.sizes))

        return self._once("anchors", make)

    @property
    def keys(self) -> np.ndarray:
        """Row and hash of every entry, in order."""
        return self._once("keys", lambda: self.rows << 32 | ((self.xs >> 32) + (1 << 31)))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, slots and entries of each print's distinct hashes."""
        first = _firsts(self.keys)
        return self.keys[first] >> 32, slots(self.xs[first] >> 32), np.diff(np.append(first, len(self.xs)))

    def postings(self, least: float) -> tuple[np.ndarray, ...]:
        """k of each print; and of each slot where its postings begin, their rows and entries.

        To score, a print needs `need` = least * anchors of its entries
        matched. If need - k of its entries, those of the hashes that are most
        frequent in this block, are left out, k of the others must have a
        match. Which are left out decides the cost and nothing else.
        """

        def make():
            need = np.maximum(np.ceil(self.anchors * least - 1e-9), 1).astype(np.int64)
            k = np.where(need <= 3, need, need // 2 + 1)
            row, slot, c = self.hashes()
            often = np.minimum(np.bincount(slot, minlength=SLOTS)[slot], 4095)
            order = np.sort(row << 39 | (4095 - often) << 27 | np.arange(len(row))) & ((1 << 27) - 1)
            row, slot, c = row[order], slot[order], c[order]
            total = np.cumsum(c)
            kept = total - self.ends[row] > (need - k)[row]
            key = np.sort(slot[kept] << 40 | row[kept] << 16 | np.minimum(c[kept], 65535))
            begins = np.append(0, np.cumsum(np.bincount(key >> 40, minlength=SLOTS))).astype(np.int32)
            return np.minimum(k, 65535), begins, (key >> 16 & 0xFFFFFF).astype(np.int32), (key & 0xFFFF).astype(np.int32)

        return self._once(f"postings {least}", make)


def meetings(block: Prints, others: Prints, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in block, in others) of all pairs in which the block's print may score `least` in the other; none is missed."""
    k, begins, rows, entries = block.postings(least)
    b, slot, _ = others.hashes()
    n = (begins[slot + 1] - begins[slot]).astype(np.int64)
    b, slot, n = b[n > 0], slot[n > 0], n[n > 0]
    total, at, found = np.cumsum(n), 0, [(np.zeros(0, np.int64),) * 2]
    while at < len(b):
        # whole prints, at least one
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, "right"))
        if end < len(b):
            low = int(np.searchsorted(b, b[end], "left"))
            end = low if low > at else int(np.searchsorted(b, b[at], "right"))
        place = _runs(begins[slot[at:end]].astype(np.int64), n[at:end])
        key = np.sort(((np.repeat(b[at:end] - b[at], n[at:end]) * len(block.sizes) + rows[place]) << 16) | entries[place])
        pair = key >> 16
        first = _firsts(pair)
        count, pair = np.add.reduceat(key & 0xFFFF, first), pair[first]
        x, y = pair % len(block.sizes), pair // len(block.sizes) + b[at]
        enough = count >= k[x]
        found.append((x[enough], y[enough]))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _prominences(pair: np.ndarray, offset: np.ndarray, anchor: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Scores of pairs 0, 1, ... from their matches, as kernels.offset_scores gives them one by one."""
    out = np.zeros(len(anchors))
    if not len(pair):
        return out
    key = np.sort(pair << 42 | (offset + (1 << 21)) << 20 | anchor)
    key = key[_firsts(key)]
    at = key >> 20
    first = _firsts(at)
    occur = at[first]
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    beside = np.append(np.diff(occur) == 1, False)
    anchor = key & (LATEST - 1)
    up, down = beside[group], np.append(False, beside[:-1])[group]
    every = np.sort(np.concatenate([group << 20 | anchor, (group[up] + 1) << 20 | anchor[up], (group[down] - 1) << 20 | anchor[down]]))
    merged = np.bincount(every[_firsts(every)] >> 20, minlength=len(first))
    of = occur >> 22
    begin = _firsts(of)
    count = np.diff(np.append(begin, len(of)))
    best, total = np.maximum.reduceat(merged, begin), np.add.reduceat(merged, begin)
    rest = np.where(count > 1, (total - best) / np.maximum(count - 1, 1), 0.0)
    out[of[begin]] = np.clip((best - rest) / anchors[of[begin]], 0.0, 1.0)
    return out


def _matches(x: Prints, i: np.ndarray, y: Prints, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pair, time in x and time in y of every two entries of prints i of x and j of y that have one hash; whole pairs at a time.

    Pairs with more than MATCHES are left out.
    """
    n = x.sizes[i]
    at = _runs(x.ends[i], n)
    pair = np.repeat(np.arange(len(i)), n)
    want = np.repeat(j, n) << 32 | x.keys[at] & 0xFFFFFFFF
    lo = np.searchsorted(y.keys, want, "left")
    hit = np.flatnonzero(y.keys[np.minimum(lo, len(y.keys) - 1)] == want)
    pair, at, lo, want = pair[hit], at[hit], lo[hit], want[hit]
    n = np.searchsorted(y.keys, want, "right") - lo
    pair, at, lo, n = (v[np.bincount(pair, n, len(i))[pair] <= MATCHES] for v in (pair, at, lo, n))
    total = np.cumsum(np.bincount(pair, n, len(i)).astype(np.int64)) // ENTRIES
    cuts = np.searchsorted(pair, np.append(0, np.flatnonzero(np.diff(total)) + 1))
    for a, b in zip(cuts, np.append(cuts[1:], len(pair))):
        yield np.repeat(pair[a:b], n[a:b]), np.repeat(x.xs[at[a:b]] & 0xFFFFFFFF, n[a:b]), y.xs[_runs(lo[a:b], n[a:b])] & 0xFFFFFFFF


def pair_scores(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of prints i of a in prints j of b, and of the latter in the former."""
    ab, ba = np.zeros(len(i)), np.zeros(len(i))
    smaller = np.minimum(a.sizes[i], b.sizes[j])
    late = [np.maximum.reduceat(np.append(x.xs & 0xFFFFFFFF, 0), x.ends[:-1]) >= LATEST if len(x.sizes) else np.zeros(0, bool) for x in (a, b)]
    single = late[0][i] | late[1][j]
    for swap in (False, True):
        todo = np.flatnonzero(~single & ((a.sizes[i] > b.sizes[j]) == swap))
        total, at = np.cumsum(smaller[todo]), 0
        while at < len(todo):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ENTRIES, "right")))
            of = todo[at:end]
            some = np.zeros(len(of), bool)
            for pair, tx, ty in _matches(b, j[of], a, i[of]) if swap else _matches(a, i[of], b, j[of]):
                ta, tb = (ty, tx) if swap else (tx, ty)
                some[pair] = True
                ab[of] += _prominences(pair, tb - ta, ta, a.anchors[i[of]])
                ba[of] += _prominences(pair, ta - tb, tb, b.anchors[j[of]])
            single[of[~some]] = True
            at = end
    for p in np.flatnonzero(single):
        x, y = (s.xs[s.ends[q] : s.ends[q + 1]] for s, q in ((a, i[p]), (b, j[p])))
        ab[p], ba[p] = kernels.offset_scores(x, y)
    return ab, ba


def near(block: Prints, others: Prints, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (in block, in others) and both scores of the pairs of different ids that this direction has to give.

    A pair is given where the block's print scores `least`; if both directions
    do, only from the smaller id.
    """
    i, j = meetings(block, others, least)
    ids, other = np.asarray(block.ids)[i], np.asarray(others.ids)[j]
    wanted = (ids != other) & ((block.sides[i] != others.sides[j]) | (block.sides[i] < 0))
    i, j, ids, other = i[wanted], j[wanted], ids[wanted], other[wanted]
    ab, ba = pair_scores(block, i, others, j)
    given = (ab >= least) & ((ba < least) | (ids < other))
    return i[given], j[given], ab[given], ba[given]
