"""A compressed full-text index of one shard: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

from quadrille.llm.suffixes import dense, pointed, refine


class FMIndex:
    """Over passages of dense symbols 1..sigma-1; each passage ends with its own mark, all smaller.

    ``count`` walks one rank per bit of a symbol, for many queries at a time."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, sigma: int):
        passages = len(offsets) - 1
        text = np.insert(symbols + (passages - 1), offsets[1:], np.arange(passages))
        n = len(text)
        rank, step, ends = dense(text), 1, np.full(n, n, dtype=np.int64)
        counts = np.bincount(rank, minlength=n)
        active = np.flatnonzero(counts[rank] > 1)
        while len(active):
            rank, active = refine(rank, pointed(rank, ends, step), active)
            step *= 2
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        last = text[suffixes - 1] - (passages - 1)  # every mark becomes 0 or less
        last[last < 0] = 0
        self.suffixes, self.size, self.bits = suffixes, n, max(1, int(sigma - 1).bit_length())
        held = np.bincount(last, minlength=sigma)
        held[0] = passages
        self.before = np.concatenate(([0], np.cumsum(held)))[:sigma]
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            row = (last >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(row, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            last = np.concatenate((last[row == 0], last[row == 1]))
        self.begin = self._walk(np.zeros(sigma, dtype=np.int64), np.arange(sigma))

    def _walk(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][i]
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def backward(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that start with the symbol and go on as those of [low, high)."""
        base = self.before[symbol] - self.begin[symbol]
        return base + self._walk(low, symbol), base + self._walk(high, symbol)
