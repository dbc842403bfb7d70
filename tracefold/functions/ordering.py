"""Order within long keys: rows are dealt by key and time cell, and what crosses a cell's edge comes from a small table of cells.

A window over the key alone would put a whole long trace into one task. There a
task holds one of CELLS time cells of a key; the cells themselves, at most
CELLS rows a key, are ordered by one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELLS = 4096


def celled(df: DataFrame, key: str, at: str, spans: DataFrame | None = None, cells: int = CELLS) -> DataFrame:
    """Adds _cell, the time cell of a row within the range of its key (``spans``: key, _lo, _hi)."""
    if spans is None:
        spans = df.groupBy(key).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    place = F.floor((F.col(at) - F.col("_lo")).cast("double") * cells / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    return df.join(spans, key).withColumn("_cell", F.greatest(F.lit(0), F.least(F.lit(cells - 1), place))).drop("_lo", "_hi")


def following(df: DataFrame, key: str, order: list[str], value: str, cells: int = CELLS, long: bool = True) -> DataFrame:
    """Adds next_<value>: the value of the key's next row in the order, whose first column is a time. Keys that fit a task (not ``long``) take a plain window."""
    if not long:
        return df.withColumn(f"next_{value}", F.lead(value).over(W.partitionBy(key).orderBy(*order)))
    c = celled(df, key, order[0], None, cells)
    heads = c.groupBy(key, "_cell").agg(F.min(F.struct(*order, value)).alias("_head"))
    heads = heads.select(key, "_cell", F.lead(f"_head.{value}").over(W.partitionBy(key).orderBy("_cell")).alias("_after"))
    inner = F.lead(F.struct(value)).over(W.partitionBy(key, "_cell").orderBy(*order))
    return c.withColumn("_next", inner).join(heads, [key, "_cell"]).withColumn(f"next_{value}", F.when(F.col("_next").isNull(), F.col("_after")).otherwise(F.col(f"_next.{value}"))).drop("_cell", "_next", "_after")


def numbered(df: DataFrame, key: str, order: list[str], name: str, cells: int = CELLS, long: bool = True) -> DataFrame:
    """Adds the row's number (from 1) within its key. Keys that fit a task (not ``long``) take a plain window."""
    if not long:
        return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))
    c = celled(df, key, order[0], None, cells)
    sizes = c.groupBy(key, "_cell").agg(F.count("*").alias("_k"))
    sizes = sizes.select(key, "_cell", (F.sum("_k").over(W.partitionBy(key).orderBy("_cell")) - F.col("_k")).alias("_before"))
    return c.withColumn("_own", F.row_number().over(W.partitionBy(key, "_cell").orderBy(*order))).join(sizes, [key, "_cell"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_cell", "_before", "_own")


def neighbours(probes: DataFrame, df: DataFrame, key: str, at: str, value: str, cells: int = CELLS) -> DataFrame:
    """Adds before and after to the probes: the struct ``value`` of the last row earlier than the probe and of the first row at its time or later.

    probes and df have the key and ``at``; ``value`` orders rows of equal time.
    """
    spans = df.groupBy(key).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    rows = celled(df.select(key, at, value), key, at, spans, cells)
    asked = celled(probes.withColumn("_probe", F.struct(*probes.columns)), key, at, spans, cells)
    # of rows at one time only the first counts
    rows = rows.groupBy(key, "_cell", at).agg(F.min(value).alias(value))
    both = rows.withColumn("_probe", F.lit(None).cast(asked.schema["_probe"].dataType)).unionByName(asked.select(key, "_cell", at, "_probe").withColumn(value, F.lit(None).cast(rows.schema[value].dataType)))
    inside = W.partitionBy(key, "_cell").orderBy(at, F.col("_probe").isNull())
    both = both.withColumns({"_b": F.last(value, True).over(inside.rowsBetween(W.unboundedPreceding, -1)), "_seen": F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(at), F.col(value).alias("v")))).over(W.partitionBy(key, "_cell").orderBy(F.desc(at), F.col("_probe").isNotNull()).rowsBetween(W.unboundedPreceding, 0))})
    ends = both.groupBy(key, "_cell").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at, value))).alias("_last"), F.min(F.when(F.col(value).isNotNull(), F.struct(at, value))).alias("_first"))
    order = W.partitionBy(key).orderBy("_cell")
    ends = ends.select(key, "_cell", F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_left"), F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_right"))
    found = both.where("_probe is not null").join(ends, [key, "_cell"])
    return found.select("_probe.*", F.coalesce("_b", f"_left.{value}").alias("before"), F.coalesce("_seen.v", f"_right.{value}").alias("after"))
