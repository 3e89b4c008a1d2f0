"""An FM-index over a sequence of small integers: Burrows-Wheeler transform, wavelet tree, sampled suffix positions.

All searches and locations are done for many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text in order, by prefix doubling; text must end with its only least symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class BitVector:
    """Ranks of ones, by a count for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)])
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)


class WaveletTree:
    """Ranks of symbols: one bit vector per level, nodes side by side in each level, zeros of all nodes first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position i."""
        low, high = np.zeros(len(symbol), np.int64), i.astype(np.int64)
        for level, (vector, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = vector.rank1(low), vector.rank1(high)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        at, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level, (vector, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = vector.rank1(at)
            bit = vector.rank1(at + 1) - ones
            out |= bit << (self.bits - 1 - level)
            at = np.where(bit.astype(bool), zeros + ones, at - ones)
        return out


class FMIndex:
    """Over symbols 1..2**bits - 1; 0 ends the text. Every ``every``-th text position is kept."""

    def __init__(self, text: np.ndarray, every: int = 8):
        text = np.append(text.astype(np.int64), 0)
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        bits = max(1, int(text.max()).bit_length())
        self.tree, self.size = WaveletTree(bwt, bits), n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        sampled = order % every == 0
        self.sampled, self.positions, self.symbols = BitVector(sampled), order[sampled], 1 << bits

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern (rows, padded at the left), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            symbol = patterns[:, width - 1 - step]
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            s = symbol[live]
            known = s < self.symbols
            low[live[~known]] = high[live[~known]] = 0
            live, s = live[known], s[known]
            low[live] = self.first[s] + self.tree.rank(s, low[live])
            high[live] = self.first[s] + self.tree.rank(s, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each by stepping back to a sampled one."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            before = self.sampled.rank1(here)
            hit = self.sampled.rank1(here + 1) > before
            done = open_[hit]
            out[done] = self.positions[before[hit]] + steps[done]
            open_ = open_[~hit]
            if len(open_):
                here = at[open_]
                symbol = self.tree.access(here)
                at[open_] = self.first[symbol] + self.tree.rank(symbol, here)
                steps[open_] += 1
        return out
