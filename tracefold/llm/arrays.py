"""Vectorised word and n-gram hashing over Arrow string columns, used inside Spark tasks.

A column is handled in slices of bounded bytes, so memory follows the slice
(or the longest single text), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bases of two independent hashes; odd, so that they have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = tuple(mix64(np.arange(1, 257, dtype=U) * U(b)) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, base & (2**64 - 1), dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def string_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets, bytes) of consecutive slices; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes (lower-cased A-Z first, if asked), from one pass of prefix sums; ``which`` of the two."""
    table = _BYTES[which][_LOWER] if lower else _BYTES[which]
    sums = np.zeros(len(data) + 1, dtype=U)
    sums[1:] = table[data]
    sums[1:] *= powers(BASES[which], len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers(_INVERSES[which], len(data))[starts])


def rolling_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of each run of k consecutive word hashes (over the ends of texts too; the caller masks those)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=U)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(hashes * powers(BASES[which], n), out=sums[1:])
    return mix64((sums[k:] - sums[: n + 1 - k]) * powers(_INVERSES[which], n)[: n + 1 - k] + U(k))


def run_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a run of k words of one text starts, and the text of each."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(len(text)) - ahead[text] + first[:-1][text], text
