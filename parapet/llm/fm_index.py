"""FM-index of a sequence of symbols, with a wavelet matrix for ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, by prefix doubling. Zeros are separators, all distinct, in text order."""
    n = len(s)
    separators = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        if width < n:
            follow[:-width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n < 2 or new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Counts and finds phrases (of symbols from 1 on) in a sequence where 0 separates texts."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.append(s, 0)
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        # below[c]: symbols less than c
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        place = order
        known = (place % SAMPLE == 0) | (self.bwt == 0)
        self.known = known
        self.at = np.where(known, place, 0)[known]
        self.nth = np.cumsum(known) - known
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        now = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs in the first i places of the transform."""
        start = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1) == 1
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[start], ones[i]
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, last row + 1) of the phrases that occur. Phrases are rows, aligned at their ends."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1] if len(phrases) else 0
        for step in range(1, width + 1):
            go = lengths[which] >= step
            c = phrases[which[go], width - step]
            lo[go] = self.below[c] + self.rank(c, lo[go])
            hi[go] = self.below[c] + self.rank(c, hi[go])
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of these rows begin: back to a sampled one, then forth."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            done = self.known[row]
            out[todo[done]] = self.at[self.nth[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            c = self.bwt[row]
            row = self.below[c] + self.rank(c, row)
            steps += 1
        return out
