"""Line deduplication over overlapping three-line windows.

Every run of three consecutive lines (split at ``\\n``) is hashed to 128 bits.
A window's first occurrence is the one with the smallest (doc_id, hash of the
text, line); the lines covered by any later occurrence are removed, overlapping ones merged.

Counting combines on the map side, so a window that a third of all documents
share reaches the shuffle once per task. The repeated windows are written
before they are joined back to their occurrences: both sides of that join are
then plain exchanges, which adaptive execution splits when one window is hot.

Defined results: null text has no lines and stays null; documents of fewer
than three lines are unchanged; windows of three blank lines never count;
rows that repeat a doc_id and its text are one document, different texts under
one doc_id are documents of their own, and a null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_struct, settle

WINDOW = 3


def lines_of(text):
    return F.split(text, "\n")


def repeated_positions(docs: DataFrame) -> DataFrame:
    """Per document with repeats: doc_id, text_hash, covered (sorted distinct numbers of the lines to remove, from 0)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    joined = F.when(F.size("lines") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)), lambda i: F.array_join(F.slice("lines", i, WINDOW), "\n")))
    windows = lines.select("doc_id", "text_hash", F.posexplode(F.transform(joined, lambda w: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"), (F.trim(w, F.lit(" \t\n\r")) == "").alias("blank")))).alias("at", "w"))
    windows = windows.where("not w.blank").select("w.h1", "w.h2", F.struct("doc_id", "text_hash", "at").alias("place"))
    firsts = settle(windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(firsts, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return (
        later.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash"))
        .agg(F.collect_set("place.at").alias("starts"))
        .select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))).alias("covered"))
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row (all its columns as they were), text (repeated lines cut), n_lines, n_removed."""
    rows = docs.select(in_struct(docs).alias("row"), F.xxhash64("text").alias("hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    both = rows.join(repeated_positions(docs), same, "left").withColumn("lines", lines_of(F.col("row.text")))
    lines = F.col("lines")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered")), lambda i: F.get(lines, i)), "\n")
    return both.select(
        "row",
        F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(kept).alias("text"),
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
