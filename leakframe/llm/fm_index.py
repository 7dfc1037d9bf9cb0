"""An FM-index over a shard's words: suffix array by doubling, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # every so manyth position of the text keeps its place in the suffix array


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``codes`` (dense, from 0) in sorted order; a suffix's end sorts first."""
    n = len(codes)
    rank = codes.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    groups = _ranks(rank[order])
    rank[order] = groups
    loose = np.arange(n)  # places of the order whose suffixes are not told apart yet
    span = 1
    while True:
        tied = _tied(rank[order[loose]])
        loose = loose[tied]
        if not len(loose):
            return order
        at = order[loose]
        ahead = np.where(at + span < n, rank[np.minimum(at + span, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        order[loose] = at[by]
        key = key[by]
        own = rank[at[by]]
        # Ranks stay the place of a group's first member, so untouched groups keep theirs.
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        start = np.ones(len(own), bool)
        start[1:] = own[1:] != own[:-1]
        head = np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
        rank[at[by]] = own + first - head
        span *= 2


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the place of the first equal value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _tied(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    tied = np.zeros(len(ranks), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return tied


class Wavelet:
    """Ranks of any symbol in a sequence: a bit vector with counts for each bit of the symbols, the highest first."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            up = ((codes >> bit) & 1).astype(bool)
            ones = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(up, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(codes) - int(ones[-1]))
            codes = np.concatenate([codes[~up], codes[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        low, place = np.zeros(len(at), np.int64), at.astype(np.int64)
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[place + 1] > ones[place]
            symbol = symbol * 2 + up
            low = np.where(up, zeros + ones[low], low - ones[low])
            place = np.where(up, zeros + ones[place], place - ones[place])
        return symbol, place - low


class FMIndex:
    """Index of a sequence of symbols 1, 2, ...; phrases are found from their last symbol backwards."""

    def __init__(self, codes: np.ndarray, symbols: int):
        codes = np.append(codes, 0)  # the end, smaller than all
        order = suffix_array(codes)
        self.before = Wavelet(codes[order - 1], symbols + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=symbols + 1))])
        sampled = order % SAMPLE == 0
        self.is_sampled, self.samples = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``phrases``; all phrases take a step at a time."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.less[-1], np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.less[symbol] + self.before.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.before.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(high, low)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places of the suffix array: step back to a sampled one and add the steps."""
        out, at = np.zeros(len(places), np.int64), places.astype(np.int64)
        open_, steps = np.arange(len(places)), 0
        while len(open_):
            known = self.is_sampled[at + 1] > self.is_sampled[at]
            out[open_[known]] = self.samples[self.is_sampled[at[known]]] + steps
            open_, at = open_[~known], at[~known]
            symbol, rank = self.before.access(at)
            at = self.less[symbol] + rank
            steps += 1
        return out
