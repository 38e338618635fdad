"""FM-index over a sequence of small integers, with vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling over sorted rank pairs."""
    n = len(seq)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector with prefix counts per bit of a symbol, most significant first,
    zeros sorted before ones from level to level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        at = seq.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (at >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(at) - self.ones[-1][-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[start].astype(np.int64), ones[end].astype(np.int64)
            start, end = np.where(bit == 1, zeros + a, start - a), np.where(bit == 1, zeros + b, end - b)
        return end - start


class FMIndex:
    """``seq`` holds symbols from 1; the end is marked by a 0 of its own."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        text = np.concatenate((seq, [0])).astype(np.int64)
        sa = suffix_array(text)
        self.n, self.sample = len(text), sample
        bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1)))).astype(np.int64)
        self.bwt, self.tree = bwt, WaveletTree(bwt, max(1, int(symbols).bit_length()))
        self.marked = sa % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(self.marked))).astype(np.int64)
        self.sampled = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows of equal length), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = np.maximum(low, self.first[symbol] + self.tree.rank(symbol, high))
            if not (high > low).any():
                break
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the pattern, position) of every occurrence: steps back to a sampled suffix."""
        counts = high - low
        pattern = np.repeat(np.arange(len(low)), counts)
        row = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        back = np.zeros(len(row), np.int64)
        open_ = ~self.marked[row]
        while open_.any():
            at = row[open_]
            symbol = self.bwt[at]
            row[open_] = self.first[symbol] + self.tree.rank(symbol, at)
            back[open_] += 1
            open_ = ~self.marked[row]
        return pattern, self.sampled[self.marks[row]] + back
