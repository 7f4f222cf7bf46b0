"""An FM-index over a sequence of symbols: suffix array, Burrows-Wheeler transform with wavelet-matrix ranks, backward
search, and positions from samples."""

from __future__ import annotations

import numpy as np

#: Every so many places of the sequence the suffix array is kept.
SAMPLE = 16
#: Symbols of a sequence, breaks included, must number fewer, so that three make up one sort key.
MOST_SYMBOLS = 1 << 21


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (non-negative numbers below MOST_SYMBOLS, the last one alone the smallest): sorted by
    three symbols, then by twice as many each round, in which only those still tied are sorted again."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64), np.zeros(2, np.int64)])
    key = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2:]
    order = np.argsort(key, kind="stable")
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = np.diff(key[order]) != 0
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    length = 3
    while not first.all():
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        who = order[at]
        after = who + length
        key = rank[who] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        order[at], key = who[turn], key[turn]
        starts = np.ones(len(at), bool)
        starts[1:] = np.diff(key) != 0
        first[at] = starts
        rank[order[at]] = np.maximum.accumulate(np.where(starts, at, 0))
        length *= 2
    return order


class FMIndex:
    """Index of a sequence of words 2, 3, ... and breaks 1. No match spans a break: each is a symbol of its own to the
    order, so suffixes are told apart at the next break, and the place after a break is always a sample."""

    def __init__(self, words: np.ndarray, n_symbols: int):
        seq = np.concatenate([words.astype(np.int64), [1, 0]])  # the end is the smallest symbol, after a last break
        n, breaks = len(seq), np.flatnonzero(seq == 1)
        unique = np.where(seq > 1, seq + len(breaks), seq)
        unique[breaks] = 1 + np.arange(len(breaks))
        if n_symbols + len(breaks) >= MOST_SYMBOLS:
            raise ValueError("too many symbols for one index")
        order = suffix_array(unique)
        bwt = seq[order - 1].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))])
        self.levels = range(max(1, int(n_symbols).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = {}, {}
        for b in self.levels:
            bit = (bwt >> b & 1).view(np.uint32).astype(bool)
            self.ones[b] = np.zeros(n + 1, np.int32)
            np.cumsum(bit, dtype=np.int32, out=self.ones[b][1:])
            self.zeros[b] = n - int(self.ones[b][-1])
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.block = self._through(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))  # where a symbol's own begin
        sampled = (order % SAMPLE == 0) | (seq[order - 1] <= 1)
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n = n

    def _through(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b in self.levels:
            ones = self.ones[b][at]
            at = np.where(symbol >> b & 1, self.zeros[b] + ones, at - ones)
        return at

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """starts[symbol] + how many of the symbol stand before place `at` of the transform."""
        return self.starts[symbol] + self._through(symbol, at) - self.block[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) rows of each phrase's suffixes. phrases: one row each, its words right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            on = np.flatnonzero((lengths > back) & (low < high))
            symbol = phrases[on, width - 1 - back]
            low[on], high[on] = self._step(symbol, low[on]), self._step(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of the suffix in each row: steps back until a sample is met."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            row = at[walking]
            through, symbol = row, np.zeros(len(row), np.int64)
            for b in self.levels:
                ones = self.ones[b][through]
                bit = self.ones[b][through + 1] - ones
                symbol |= bit.astype(np.int64) << b
                through = np.where(bit, self.zeros[b] + ones, through - ones)
            at[walking] = self.starts[symbol] + through - self.block[symbol]
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.place[at]] + steps
