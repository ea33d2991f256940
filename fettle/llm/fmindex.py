"""An FM-index over a sequence of small integers: counting and finding phrases by backward search.

The Burrows-Wheeler transform is held as a wavelet matrix, ranks are prefix counts per bit level, and every eighth place
of the text keeps its suffix position. All queries run on arrays of many phrases at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the sorted prefix; ``text`` ends with a symbol that stands nowhere else."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        key = rank * (len(text) + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = fresh
        if fresh[-1] == len(text) - 1:
            return order
        step *= 2


class FMIndex:
    """``text``: positive symbols; 0 is the end mark, which is added."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text) if len(text) > 1 else np.zeros(1, np.int64)
        row = text[order - 1]
        self.size = len(text)
        self.top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.levels = []
        for bit in reversed(range(max(1, self.top.bit_length()))):
            ones = (row >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), len(row) - int(ones.sum())))
            row = row[np.argsort(ones, kind="stable")]
        held = order % SAMPLE == 0
        self.held = held
        self.nth = np.cumsum(held) - 1
        self.places = order[held]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``upto`` rows of the transform."""
        low = np.zeros_like(upto)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low, upto = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, upto))
        return upto - low

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        symbol, low, at = np.zeros_like(row), np.zeros_like(row), row
        for _, ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            symbol = symbol * 2 + one
            low, at = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, at))
        return self.before[symbol] + at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows whose suffixes begin with each phrase (rows of a matrix, filled up on the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            symbol = phrases[live, lengths[live] - step]
            known = symbol <= self.top
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix, walking back to the next sampled one."""
        place, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.held[rows[open_]]
            done = open_[hit]
            place[done] = self.places[self.nth[rows[done]]] + steps
            open_ = open_[~hit]
            rows[open_] = self.back(rows[open_])
            steps += 1
        return place
