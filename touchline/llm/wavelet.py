"""A wavelet matrix: rank and select of small symbols in one long sequence, for arrays of questions at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Bits:
    """A bit vector with the number of ones in front of each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray, one: bool, size: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero, by bisection on ranks."""
        low, high = np.zeros_like(k), np.full_like(k, size)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            ones = self.rank(middle + 1)
            enough = (ones if one else middle + 1 - ones) > k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


class WaveletMatrix:
    """Symbols below ``2 ** levels``; the highest bit is told apart first, zeros go to the front of the next level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.size, self.levels = len(symbols), []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _down(self, symbol: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol's run begins on the last level, and where the part in front of ``at`` ends."""
        start, end = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level, bits, zeros in self.levels:
            a, b = bits.rank(start), bits.rank(end)
            start, end = (a + zeros, b + zeros) if symbol >> level & 1 else (start - a, end - b)
        return start, end

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in front of each position."""
        start, end = self._down(symbol, at)
        return end - start

    def ranks(self, symbols: Iterable[int], at: np.ndarray) -> np.ndarray:
        """How often any of ``symbols`` occurs in front of each position: sums of ranks, of whichever set is smaller."""
        wanted = set(symbols)
        rest = set(range(1 << len(self.levels))) - wanted
        if len(rest) < len(wanted):
            return at - sum((self.rank(s, at) for s in rest), np.zeros_like(at))
        return sum((self.rank(s, at) for s in wanted), np.zeros_like(at))

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) occurrence of ``symbol``; it has to exist."""
        start, _ = self._down(symbol, np.zeros(1, dtype=np.int64))
        at = start + k
        for level, bits, zeros in reversed(self.levels):
            one = bool(symbol >> level & 1)
            at = bits.select(at - zeros if one else at, one, self.size)
        return at

    def bisect(self, symbols: Iterable[int], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least position of [low, high] in front of which at least ``wanted`` of ``symbols`` lie; else ``high``."""
        symbols, low, high = tuple(symbols), low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.ranks(symbols, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
