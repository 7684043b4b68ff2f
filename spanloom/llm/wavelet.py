"""Ordered queries over slices of an integer array, many at a time.

A wavelet matrix keeps one bit per value and level (high bits first), packed into words with
a running count, about 1.5 bits per value and level in all. Queries are numpy arrays, so the
work per level is a few array operations however many queries there are.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
SIX = np.uint64(6)
LOW = np.uint64(63)


class Bits:
    """A bit vector that counts ones before a position."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        raw = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        raw[:len(packed)] = packed
        self.words = raw.view(np.uint64)
        before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=before[1:])
        self.before = before.astype(np.uint32 if len(bits) < 1 << 32 else np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        mask = (ONE << (at.astype(np.uint64) & LOW)) - ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Values of ``values[l:r]`` below a bound, and the k-th smallest of them."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            self.bits.append(Bits(bit))
            low = values[~bit]
            self.zeros.append(len(low))
            values = np.concatenate([low, values[bit]])

    def below(self, l: np.ndarray, r: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of ``values[l:r]`` are less than ``bound``."""
        top = bound >= 1 << self.levels
        out = np.where(top, r - l, 0)
        l, r = l.copy(), r.copy()
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (bound >> (self.levels - 1 - level)) & 1 == 1
            a, b = bits.ones(l), bits.ones(r)
            out += np.where(one & ~top, (r - b) - (l - a), 0)
            l, r = np.where(one, zeros + a, l - a), np.where(one, zeros + b, r - b)
        return out

    def kth(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of ``values[l:r]``; k < r - l."""
        l, r, k = l.copy(), r.copy(), k.copy()
        out = np.zeros(len(l), np.int64)
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            a, b = bits.ones(l), bits.ones(r)
            low = (r - b) - (l - a)
            one = k >= low
            k = np.where(one, k - low, k)
            out |= one.astype(np.int64) << (self.levels - 1 - level)
            l, r = np.where(one, zeros + a, l - a), np.where(one, zeros + b, r - b)
        return out
