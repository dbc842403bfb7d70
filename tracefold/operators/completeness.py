"""Does a clipped export still say the same as the full trace within its window?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import clipped, in_window

TOLERANCE = 1e-6


def compare_by_key(full: DataFrame, clipped: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows that are missing, extra or different, with the names of the differing fields and the largest difference of a number."""
    f = full.select(*key, F.struct(*fields).alias("f"))
    c = clipped.select(*key, F.struct(*fields).alias("c"))
    types = dict(full.select(*fields).dtypes)

    def same(x: str):
        a, b = F.col(f"f.{x}"), F.col(f"c.{x}")
        close = F.abs(a - b) <= TOLERANCE if types[x] in ("double", "float", "bigint", "int") else a == b
        return F.coalesce(close, a.isNull() & b.isNull())

    j = f.join(c, key, "full")
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("f").isNull(), "extra").otherwise("different")
    wrong = F.array_join(F.array_compact(F.array(*[F.when(~same(x), x) for x in fields])), ",")
    numbers = [F.abs(F.col(f"f.{x}") - F.col(f"c.{x}")).cast("double") for x in fields if types[x] in ("double", "float", "bigint", "int")]
    delta = F.round(F.greatest(*numbers, F.lit(0.0)), 6) if numbers else F.lit(0.0)
    out = j.select(*key, kind.alias("finding"), F.when(F.col("f").isNotNull() & F.col("c").isNotNull(), wrong).otherwise("").alias("fields"), delta.alias("delta"))
    return out.where("finding <> 'different' or fields <> ''")


def resource_totals(t, scope: DataFrame) -> DataFrame:
    """dataset_id, kind, id, first, second: runtime and blocked time of tasks, runtime and switches of cores, events and blocked time of objects, in the scope."""
    run, states, e = clipped(t.slices, scope), clipped(t.states.where("state = 'BLOCKED'"), scope), in_window(t.events, scope)
    pick = lambda df, kind, ident, first, second: df.where(F.col(ident).isNotNull()).select("dataset_id", F.lit(kind).alias("kind"), F.col(ident).cast("long").alias("id"), first.alias("first"), second.alias("second"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = [
        pick(run, "task", "task_id", F.col("clipped"), none),
        pick(states, "task", "task_id", none, F.col("clipped")),
        pick(run, "core", "core_id", F.col("clipped"), none),
        pick(e.where("event_name = 'CTX_SWITCH'"), "core", "core_id", none, one),
        pick(e, "object", "obj_id", one, none),
        pick(states, "object", "related_obj", none, F.col("clipped")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("dataset_id", "kind", "id").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


def verdict(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Per dataset: strict_pass without findings, bounded_pass with extras only, else fail."""
    g = findings.groupBy("dataset_id").agg(F.count_if(F.col("finding") == "missing").alias("missing"), F.count_if(F.col("finding") == "extra").alias("extra"), F.count_if(F.col("finding") == "different").alias("different"))
    j = scope.select("dataset_id").join(g, "dataset_id", "left").na.fill(0)
    return j.withColumn("verdict", F.when(F.col("missing") + F.col("extra") + F.col("different") == 0, "strict_pass").when(F.col("missing") + F.col("different") == 0, "bounded_pass").otherwise("fail"))


def lost_edges(full: DataFrame, clipped: DataFrame) -> DataFrame:
    """Edges of the full trace that the clipped one lacks."""
    key = ["dataset_id", "edge_kind", "task_id", "obj_id", "evidence_ref"]
    f, c = full.select(*key), clipped.select(*key)
    return f.exceptAll(c)
