"""A wavelet matrix over the character classes of UTF-8 bytes, with ranks for many places at once.

Each byte has one of eight classes. Level by level (one bit of the class, the
highest first) the bits are packed into 64-bit words with running counts, and
the bytes are dealt to zeros and ones for the next level. The number of bytes
of a class before a place (its rank) then takes one count per level, whatever
the length of the text; a set of classes is the sum of their ranks.
"""

from __future__ import annotations

import numpy as np

LEVELS = 3
INSIDE, NEWLINE, BLANK, DIGIT, LETTER, OTHER, LEAD2, LEAD3 = range(1 << LEVELS)


def byte_classes() -> np.ndarray:
    """The class of each of the 256 bytes; every byte but INSIDE begins a code point."""
    out = np.full(256, OTHER, dtype=np.uint8)
    for first, end, name in ((9, 14, BLANK), (32, 33, BLANK), (10, 11, NEWLINE), (48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER), (0x80, 0xC0, INSIDE), (0xC0, 0xE0, LEAD2), (0xE0, 0x100, LEAD3)):
        out[first:end] = name
    return out


CLASS_OF = byte_classes()


class Bits:
    """A bit vector with constant-time counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), []
        for level in range(LEVELS - 1, -1, -1):
            bits = (symbols >> level) & 1
            ones = bits.astype(bool)
            self.levels.append((level, Bits(bits), self.n - int(np.count_nonzero(ones))))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        begin = np.zeros(1, dtype=np.int64)
        at = np.asarray(at, dtype=np.int64)
        for level, bits, zeros in self.levels:
            if symbol >> level & 1:
                begin, at = zeros + bits.ones(begin), zeros + bits.ones(at)
            else:
                begin, at = begin - bits.ones(begin), at - bits.ones(at)
        return at - begin

    def count(self, symbols: frozenset[int], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are in the set, from the ranks of the smaller of the set and its rest."""
        at = np.asarray(at, dtype=np.int64)
        rest = frozenset(range(1 << LEVELS)) - symbols
        if len(rest) < len(symbols):
            return at - sum((self.rank(s, at) for s in rest), np.zeros(at.shape, dtype=np.int64))
        return sum((self.rank(s, at) for s in symbols), np.zeros(at.shape, dtype=np.int64))

    def locate(self, symbols: frozenset[int], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place in low..high with at least k members of the set before it (high, if there is none), by bisection on ranks."""
        low, high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= k
            low, high = np.where(open_ & ~enough, middle + 1, low), np.where(open_ & enough, middle, high)
        return low
