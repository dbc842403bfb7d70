"""Window and scope predicates over events and interval tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import clip

#: Table columns that a filter key may match.
SCOPE = {"task_id": ("task_id", "delayed_task"), "core_id": ("core_id",), "event_name": ("event_name",), "obj_id": ("obj_id", "related_obj"), "irq_id": ("irq_id",)}


def in_window(df: DataFrame, scope: DataFrame) -> DataFrame:
    """Events with w_begin <= ts <= w_end, or intervals that overlap the open window; adds w_begin and w_end.

    scope: dataset_id, w_begin, w_end.
    """
    j = df.join(scope, "dataset_id")
    return j.where("t_begin < w_end and t_end > w_begin" if "t_begin" in df.columns else "ts between w_begin and w_end")


def clipped(df: DataFrame, scope: DataFrame) -> DataFrame:
    """Intervals in the window with their length inside it."""
    return in_window(df, scope).withColumn("clipped", clip("t_begin", "t_end"))


def scope_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Rows that match all keys of ``spec``; 0 is a value like any other, and a table without the key's columns has no match."""
    for key, value in spec.items():
        columns = [c for c in SCOPE["obj_id" if key == "resource_id" else key] if c in df.columns]
        match: Column = F.lit(False)
        for c in columns:
            match = match | F.coalesce(F.col(c) == value, F.lit(False))
        df = df.where(match)
    return df


def trusted_scopes(scope: DataFrame, windows: DataFrame) -> DataFrame:
    """Scopes that no untrusted window overlaps."""
    hit = windows.join(scope, "dataset_id").where("t_begin < w_end and t_end > w_begin").select("dataset_id", "w_begin", "w_end").distinct()
    return scope.join(hit, ["dataset_id", "w_begin", "w_end"], "left_anti")


def capture_filter(events: DataFrame, core_mask: int, domain_mask: int, tasks: list[int] | None = None, objects: list[int] | None = None, drop_integrity: bool = False) -> DataFrame:
    """Keep events by core bits, domain bits (bit per leading hex digit of the kind), task and object lists."""
    name = F.col("event_name")
    domain = F.when(name.startswith("SYNC_CALIB") | name.startswith("TS_") | name.isin("LOSS", "OVERFLOW"), 8).when(name.startswith("IRQ"), 4).when(name.startswith("SYNC"), 2).otherwise(1)
    keep = (F.expr(f"(1 << core_id) & {core_mask}") != 0) & (domain.bitwiseAND(domain_mask) != 0)
    if tasks is not None:
        keep &= F.col("task_id").isNull() | F.col("task_id").isin(tasks)
    if objects is not None:
        keep &= F.col("obj_id").isNull() | F.col("obj_id").isin(objects)
    if drop_integrity:
        keep &= domain != 8
    return events.where(keep)


def systematic_sample(events: DataFrame, num: int, den: int) -> DataFrame:
    """Keep ``num`` of every ``den`` events of a core, in order of seq."""
    n = F.row_number().over(W.partitionBy("dataset_id", "core_id").orderBy("seq"))
    return events.withColumn("_n", n).where((F.col("_n") - 1) % den < num).drop("_n")


def state_mask(states: DataFrame, names: list[str], tasks: list[int] | None = None, resource: int | None = None) -> DataFrame:
    out = states.where(F.col("state").isin(names))
    if tasks is not None:
        out = out.where(F.col("task_id").isin(tasks))
    return out if resource is None else out.where(F.col("related_obj") == resource)


def switch_points(events: DataFrame, task: int | None = None) -> DataFrame:
    s = events.where("event_name = 'CTX_SWITCH'").select("dataset_id", "event_uid", "core_id", "ts", "prev_task_id", "next_task_id", "reason", "trusted")
    return s if task is None else s.where((F.col("prev_task_id") == task) | (F.col("next_task_id") == task))


def graph_filter(edges: DataFrame, task: int | None = None, obj: int | None = None) -> DataFrame:
    if task is not None:
        edges = edges.where((F.col("task_id") == task) | (F.col("owner_task_id") == task))
    return edges if obj is None else edges.where(F.col("obj_id") == obj)
