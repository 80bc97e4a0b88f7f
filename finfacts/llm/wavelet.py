"""A wavelet matrix over small symbols, for many rank queries at once."""

from __future__ import annotations

import numpy as np


class _Bits:
    """Bits with the number of ones before each 64-bit word, for rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first at bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols 0 to 2**levels - 1, one bit vector a level; each level's zeros come before its ones in the next."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.size, self.levels = len(symbols), []
        for bit in range(levels - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, len(symbols) - int(ones.sum()), _Bits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often symbol stands among the first at places."""
        first, last = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bit, zeros, bits in self.levels:
            if symbol >> bit & 1:
                first, last = zeros + bits.rank(first), zeros + bits.rank(last)
            else:
                first, last = first - bits.rank(first), last - bits.rank(last)
        return last - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first at places hold one of the symbols."""
        return sum((self.rank(s, at) for s in symbols[1:]), self.rank(symbols[0], at))

    def locate(self, symbols: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the nth (from 0) of the symbols at or after low, by bisection on counts; high where there is none before it."""
        wanted = self.count(symbols, low) + nth + 1
        low, high = low.astype(np.int64), high.astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            reached = self.count(symbols, np.minimum(middle + 1, self.size)) >= wanted
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low
