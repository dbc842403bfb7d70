"""Small column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(begin, end, w_begin="w_begin", w_end="w_end") -> Column:
    """Length of [begin, end) within the window, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col(end), F.col(w_end)) - F.greatest(F.col(begin), F.col(w_begin)))


def round6(c) -> Column:
    return F.round(c, 6)


def first_present(*columns) -> Column:
    """The first that is not null; 0 counts as present."""
    return F.coalesce(*columns)


def clamp(c, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def int_of(text) -> Column:
    """Integer from decimal or 0x text; null if it is neither."""
    t = F.trim(text)
    return F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 64), 16, 10).cast("long")).when(t.rlike("^[+-]?[0-9]+$"), t.cast("long"))


def wilson(k: Column, n: Column, sign: int, z: float = 1.959963984540054) -> Column:
    """One end of the Wilson score interval of k of n; null for n = 0."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, centre + sign * half)
