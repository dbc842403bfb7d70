"""Interval overlap join and proportional bucketing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Pairs of intervals [t_begin, t_end) that overlap within the same keys.

    The right side's begin and end come back as r_begin and r_end. A pair is
    found in time cells: both sides are written to every cell of a level they
    touch, and the pair counts only in the cell where the later one begins.
    Each level has cells four times as wide as the one before; an interval
    lives on the level where it touches at most four cells, so a long one is
    not written to thousands of cells, and levels are matched with each other
    by the coarser one's cells. Both sides are written out first, as they are
    read twice.
    """
    right = right.withColumnsRenamed({"t_begin": "r_begin", "t_end": "r_end"})

    def levelled(df: DataFrame, b: str, e: str) -> DataFrame:
        length = F.greatest(F.col(e) - F.col(b), F.lit(1)).cast("double")
        # smallest level whose cell (4^level) is at least a third of the length
        return df.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(length / 3) / 2)).cast("int"))

    l, r = settle(levelled(left, "t_begin", "t_end")), settle(levelled(right, "r_begin", "r_end"))

    def celled(df: DataFrame, b: str, e: str, levels: DataFrame) -> DataFrame:
        """Copies at the own level and at every coarser level that the other side uses."""
        here = df.join(F.broadcast(levels), F.col("_join_level") >= F.col("_level"))
        width = F.pow(F.lit(4.0), F.col("_join_level")).cast("long")
        return here.withColumn("_width", width).withColumn("_cell", F.explode(F.expr(f"sequence(floor({b} / _width), floor({e} / _width))")))

    # at most 32 levels: 4^31 exceeds any timestamp range in use
    levels = l.select("_level").union(r.select("_level")).distinct().select(F.col("_level").alias("_join_level"))
    lc = celled(l, "t_begin", "t_end", levels).withColumnRenamed("_level", "_l_level").drop("_width")
    rc = celled(r, "r_begin", "r_end", levels).withColumnRenamed("_level", "_r_level")
    pairs = lc.join(rc, [*keys, "_join_level", "_cell"]).where("_join_level = greatest(_l_level, _r_level)")
    touch = "t_begin <= r_end and r_begin <= t_end" if closed else "t_begin < r_end and r_begin < t_end"
    return pairs.where(f"{touch} and _cell = floor(greatest(t_begin, r_begin) / _width)").drop("_join_level", "_cell", "_width", "_l_level", "_r_level")


def overlap_buckets(intervals: DataFrame, windows: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    """Weight of intervals per bucket of their dataset's window, in proportion to overlap.

    windows: dataset_id, w_begin, w_end. A bucket is max((w_end - w_begin) / n, 1)
    wide; an interval without length goes whole to its bucket. Adds bucket and part.
    """
    size = F.greatest((F.col("w_end") - F.col("w_begin")) / n, F.lit(1.0))
    j = intervals.join(windows, "dataset_id").where("t_begin <= w_end and t_end >= w_begin").withColumn("size", size)
    place = lambda t: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(t) - F.col("w_begin")) / F.col("size")))).cast("int")
    j = j.withColumns({"b0": place("t_begin"), "b1": place("t_end")}).withColumn("bucket", F.explode(F.sequence("b0", "b1")))
    low, high = F.col("w_begin") + F.col("bucket") * F.col("size"), F.col("w_begin") + (F.col("bucket") + 1) * F.col("size")
    length = F.col("t_end") - F.col("t_begin")
    part = F.when(length <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col("t_end"), high) - F.greatest(F.col("t_begin"), low)) / length)
    return j.withColumn("part", part * (F.col(weight) if weight else F.lit(1.0))).drop("b0", "b1", "size")
