"""FM-index over a shard of word numbers: suffix order, wavelet-tree ranks and sampled suffix positions, in numpy."""

from __future__ import annotations

import numpy as np

#: Every text position that is a multiple of this keeps its suffix position.
SAMPLE_EVERY = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros are separators; they differ from one another, by position."""
    n = len(text)
    breaks = text == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + int(breaks.sum()))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 + n) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a sequence of positive numbers in which zeros separate runs; the last symbol is a zero.

    Patterns hold positive numbers only, so no occurrence crosses a separator.
    """

    def __init__(self, text: np.ndarray, sample_every: int = SAMPLE_EVERY):
        self.n = len(text)
        order = suffix_order(text)
        self.bwt = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        # A run's start keeps its position too: nothing is looked up across a separator.
        sampled = (order % sample_every == 0) | (self.bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        # Wavelet tree, a level per bit from the highest: ones before each place, and where the ones' half starts.
        self.bits = max(1, top.bit_length())
        self.ones: list[np.ndarray] = []
        self.half: list[int] = []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.half.append(int((~bit).sum()))
            level = np.concatenate((level[~bit], level[bit]))

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` in the transform before each place, elementwise."""
        at = [np.zeros_like(places[0]), *places]
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            for k, p in enumerate(at):
                ones = self.ones[level][p]
                at[k] = np.where(one, self.half[level] + ones, p - ones)
        return [p - at[0] for p in at[1:]]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the patterns, one per line of a matrix of equal lengths, by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            known = symbol < len(self.before) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            a, b = self.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.before[symbol] + a, self.before[symbol] + b
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk backwards to a sampled one and count the steps."""
        position = np.empty(len(rows), np.int64)
        at, where, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            done = self.sampled[at]
            position[where[done]] = self.samples[self.sample_rank[at[done]]] + steps
            at, where = at[~done], where[~done]
            if len(at):
                symbol = self.bwt[at]
                at = self.before[symbol] + self.rank(symbol, at)[0]
                steps += 1
        return position
