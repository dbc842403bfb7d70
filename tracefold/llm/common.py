"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "in_struct", "next_power_of_two", "settle"]

#: White space of the word contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other alphabets."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def next_power_of_two(n: float) -> int:
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def in_struct(df: DataFrame, but: str | None = None) -> Column:
    """All columns of a row as one struct (without ``but``), so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c != but])
