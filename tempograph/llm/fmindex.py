"""FM-index over sequences of small integers: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 4


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array by prefix doubling; equal symbols at 0 are told apart by position.

    With a depth, suffixes need only be in the order of their first `depth` symbols.

    Symbol 0 is a separator: each is taken as a symbol of its own, below all
    others and growing with its position, so no comparison passes one. The
    number of rounds follows the longest run between separators.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    gaps = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(1, len(gaps) + 1)
    width, top = 1, int(rank.max()) + 1
    while True:
        key = rank * (top + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        top, width = int(step[-1]) + 1, width * 2
        if depth is not None and width >= depth:
            return order
        if top == n or width >= n:
            return order if top == n else np.lexsort((np.arange(n), rank))


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol in the first i values, for many symbols and i at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = len(values) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, end = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for level, ones, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            b1, e1 = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin, end = np.where(bit, zeros + b1, begin - b1), np.where(bit, zeros + e1, end - e1)
        return end - begin


class FMIndex:
    """Counts and locates phrases in symbols; symbols are 1..top, 0 separates."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        order = suffix_array(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.before = before
        self.tree = WaveletMatrix(before, top)
        self.less = np.searchsorted(np.sort(symbols), np.arange(top + 2))
        # a walk must not cross a separator: positions just after one are kept too
        after = np.zeros(n, bool)
        after[0:1] = True
        after[1:] = symbols[:-1] == 0
        kept = (order % SAMPLE == 0) | after[order] | (symbols[order] == 0)
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of suffixes that start with each phrase.

        `phrases` is a matrix padded at the left with 0; lengths are its used
        columns. Symbols below 1 or unknown make a phrase absent.
        """
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.before), np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lo < hi) & (lengths > phrases.shape[1] - 1 - column))
            if not len(live):
                continue
            symbol = phrases[live, column]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.less[symbol] + both[: len(live)]
            hi[live] = self.less[symbol] + both[len(live) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to a kept one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.positions[self.kept_rank[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            steps[todo] += 1
            symbol = self.before[at]
            at = self.less[symbol] + self.tree.rank(symbol, at)
        return out
