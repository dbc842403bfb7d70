"""What a row takes from the rows before and behind it in the order of its key, for keys of any length.

Short keys are plain windows. A window over one long trace, core or task would
put all of its rows into one task; there, rows are dealt by ranges of (key,
order), so a cell is one range and all cells are alike in size however
uneven the times are. Within a cell the same windows run, and a small table of
cells, one row for each key and cell, carries the last values, the first values
and the sums over the cells' edges: a prefix scan in two levels. Only keys that
span cells need it, at most two rows a cell, so it is broadcast. Numbers alone
take no window: rows are sorted by ranges, and a row's place is that in its
range and what stands before the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import settle

#: Rows of a key from which on it is scanned by cells.
LONG_KEY = 2_000_000


def is_long(df: DataFrame, keys: list[str]) -> bool:
    """Whether any key has more rows than one task should take."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (most or 0) > LONG_KEY


def _numbered(df: DataFrame, keys: list[str], order: list[str], number: str, cells: int | None) -> DataFrame:
    """Numbers by one sort: dealt by ranges and written in order, so that a row's place in its range is known without a window."""
    by = [F.col(f"`{k}`") for k in keys]
    n = cells or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = settle(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at))
    dealt = dealt.withColumns({"_cell": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    edges = dealt.groupBy(*by, "_cell").agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    names = [f"_k{i}" for i in range(len(keys))]
    edges = settle(edges.select(*[k.alias(x) for k, x in zip(by, names, strict=True)], F.col("_cell").alias("_edge"), (before - F.col("_start") + 1).alias("_shift")))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(x)) for k, x in zip(by, names, strict=True)], F.col("_cell") == F.col("_edge"))
    return dealt.join(edges, same).select(*[F.col(f"`{c}`") for c in df.columns if c != number], (F.col("_at") + F.col("_shift")).alias(number))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    number: str | None = None,
    long: bool | None = None,
    cells: int | None = None,
) -> DataFrame:
    """``df`` with, by name: the value of the row before (lag) and behind (lead), the last value that is not null
    up to this row (last), the sum up to this row (total), the greatest before this row (highest) and the row's number from 1 (number), all within the key.

    The order must tell the rows of a key apart. ``long`` says whether a key may be too long for one task; it is looked up if null.
    """
    lag, lead, last, total, highest = lag or {}, lead or {}, last or {}, total or {}, highest or {}
    if long is None:
        long = is_long(df, keys)
    by = [F.col(f"`{k}`") for k in keys]
    w = W.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    if not long:
        new = {k: F.lag(v).over(w) for k, v in lag.items()} | {k: F.lead(v).over(w) for k, v in lead.items()}
        new |= {k: F.last(v, True).over(so_far) for k, v in last.items()} | {k: F.sum(v).over(so_far) for k, v in total.items()}
        new |= {k: F.max(v).over(w.rowsBetween(W.unboundedPreceding, -1)) for k, v in highest.items()}
        return df.withColumns(new | ({number: F.row_number().over(w).cast("long")} if number else {}))

    if number and not (lag or lead or last or total or highest):
        return _numbered(df, keys, order, number, cells)

    # every value is named, so that a cell can hand it on
    sent = {f"_g{i}": v for i, v in enumerate(lag.values())}
    first = {f"_d{i}": v for i, v in enumerate(lead.values())}
    held = {f"_l{i}": v for i, v in enumerate(last.values())}
    added = {f"_s{i}": v for i, v in enumerate(total.values())}
    most = {f"_m{i}": v for i, v in enumerate(highest.values())}
    n = cells or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = settle(df.withColumns(sent | first | held | added | most))
    dealt = settle(ready.repartitionByRange(n, *by, *order).withColumn("_cell", F.spark_partition_id()))

    at = [F.col(c) for c in order]
    ends = [F.max(F.struct(*at, *sent)).alias("_tail"), F.min(F.struct(*at, *first)).alias("_head"), F.count("*").alias("_rows")]
    ends += [F.max(F.when(F.col(c).isNotNull(), F.struct(*at, c))).alias(f"{c}_end") for c in held] + [F.sum(c).alias(f"{c}_sum") for c in added]
    ends += [F.max(c).alias(f"{c}_max") for c in most]
    edges = dealt.groupBy(*by, "_cell").agg(*ends)
    over = W.partitionBy(*by).orderBy("_cell")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.lag("_tail").over(over).alias("_tail"), F.lead("_head").over(over).alias("_head"), F.sum("_rows").over(before).alias("_before")]
    carried += [F.last(f"{c}_end", True).over(before).alias(f"{c}_end") for c in held] + [F.sum(f"{c}_sum").over(before).alias(f"{c}_sum") for c in added]
    carried += [F.max(f"{c}_max").over(before).alias(f"{c}_max") for c in most]
    names = [f"_k{i}" for i in range(len(keys))]
    edges = edges.select(*[k.alias(x) for k, x in zip(by, names, strict=True)], F.col("_cell").alias("_edge"), *carried, F.count("*").over(W.partitionBy(*by)).alias("_parts"))
    edges = F.broadcast(edges.where("_parts > 1").drop("_parts"))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(x)) for k, x in zip(by, names, strict=True)], F.col("_cell") == F.col("_edge"))

    inner = W.partitionBy(*by, "_cell").orderBy(*order)
    inner_so_far = inner.rowsBetween(W.unboundedPreceding, 0)
    own = {"_n": F.row_number().over(inner), "_end": F.lead(F.lit(1)).over(inner).isNull()}
    own |= {f"{c}_own": F.lag(c).over(inner) for c in sent} | {f"{c}_own": F.lead(c).over(inner) for c in first}
    own |= {f"{c}_own": F.last(c, True).over(inner_so_far) for c in held} | {f"{c}_own": F.sum(c).over(inner_so_far) for c in added}
    own |= {f"{c}_own": F.max(c).over(inner.rowsBetween(W.unboundedPreceding, -1)) for c in most}
    both = dealt.withColumns(own).join(edges, same, "left")
    none = F.lit(0).cast("long")
    new = {k: F.when(F.col("_n") == 1, F.col(f"_tail.{c}")).otherwise(F.col(f"{c}_own")) for k, c in zip(lag, sent, strict=True)}
    new |= {k: F.when(F.col("_end"), F.col(f"_head.{c}")).otherwise(F.col(f"{c}_own")) for k, c in zip(lead, first, strict=True)}
    new |= {k: F.coalesce(f"{c}_own", f"{c}_end.{c}") for k, c in zip(last, held, strict=True)}
    new |= {k: F.when(F.col(f"{c}_own").isNull(), F.col(f"{c}_sum")).when(F.col(f"{c}_sum").isNull(), F.col(f"{c}_own")).otherwise(F.col(f"{c}_own") + F.col(f"{c}_sum")) for k, c in zip(total, added, strict=True)}
    new |= {k: F.greatest(f"{c}_own", f"{c}_max") for k, c in zip(highest, most, strict=True)}
    if number:
        new[number] = F.coalesce("_before", none) + F.col("_n")
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])
