"""Alert rules over the interval tables, and diagnoses from alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import clipped, in_window
from .intervals import overlap_join
from .metrics import deadline_analysis, deadline_status


@dataclass
class Thresholds:
    long_block: int = 100
    long_irq: int = 100
    irq_latency: int = 80


COLUMNS = ("dataset_id", "alert_id", "type", "severity", "t_begin", "t_end", "task_id", "obj_id", "irq_id", "core_id", "other_tasks", "threshold", "actual", "evidence", "support_level")


def alert(df: DataFrame, kind: str, key, **values) -> DataFrame:
    """Rows of COLUMNS; what isn't given is null."""
    none = {"task_id": "long", "obj_id": "long", "irq_id": "long", "core_id": "int", "other_tasks": "string"}
    given = {k: v if not isinstance(v, str) else F.col(v) for k, v in values.items()}
    row = {c: given[c].cast(t) if c in given else F.lit(None).cast(t) for c, t in none.items()}
    row |= {"dataset_id": F.col("dataset_id"), "alert_id": F.concat_ws(":", F.lit("alert"), F.lit(kind), key), "type": F.lit(kind), "severity": F.lit("warning")}
    row |= {c: given.get(c, F.col(c)) for c in ("t_begin", "t_end")} | {c: given[c].cast("double") for c in ("threshold", "actual")} | {c: given[c] for c in ("evidence", "support_level")}
    return df.select(*[row[c].alias(c) for c in COLUMNS])


def support(trusted):
    return F.when(trusted, "exact").otherwise("degraded")


def long_block(t, scope: DataFrame, th: Thresholds) -> DataFrame:
    s = clipped(t.states.where("state = 'BLOCKED'"), scope).where(F.col("clipped") >= th.long_block)
    return alert(s, "long_block", F.col("seg_id"), task_id="task_id", obj_id="related_obj", threshold=F.lit(th.long_block), actual=F.col("clipped"), evidence=F.col("cause_event"), support_level=support(F.col("trusted")))


def deadline_miss(t, scope: DataFrame) -> DataFrame:
    d = deadline_analysis(t.events, scope).where("deadline_miss > 0")
    return alert(
        d,
        "deadline_miss",
        F.concat_ws(":", "dataset_id", "task_id", "release_event"),
        t_begin=F.col("release_ts"),
        t_end=F.col("finish_ts"),
        task_id="task_id",
        threshold=F.greatest(F.lit(0), F.col("deadline_ts") - F.col("release_ts")),
        actual=F.col("response_time"),
        evidence=F.col("release_event"),
        support_level=support(F.col("semantics") == "precise"),
    )


def deadline_gap(t, scope: DataFrame) -> DataFrame:
    d = deadline_status(t.events, scope).where("incomplete + conflicts > 0").join(scope, "dataset_id")
    return alert(d, "deadline_semantics_gap", F.col("dataset_id"), t_begin=F.col("w_begin"), t_end=F.col("w_end"), threshold=F.lit(0), actual=F.col("incomplete") + F.col("conflicts"), evidence=F.lit(None).cast("string"), support_level=F.lit("degraded"))


def last_priorities(events: DataFrame, scope: DataFrame) -> DataFrame:
    """The last priority seen of each task in the window."""
    e = in_window(events, scope).where("prio is not null")
    return e.groupBy("dataset_id", "task_id").agg(F.max_by("prio", F.struct("ts", "core_id", "seq")).alias("prio"))


def preempting_slices(t, scope: DataFrame) -> DataFrame:
    """Blocked segments with an owner of lower urgency, and overlapping slices of tasks in between (smaller is more urgent)."""
    prio = last_priorities(t.events, scope)
    cause = t.events.select("dataset_id", F.col("event_uid").alias("cause_event"), F.col("owner_task_id").alias("owner"))
    blocked = clipped(t.states.where("state = 'BLOCKED' and related_obj is not null"), scope).join(cause, ["dataset_id", "cause_event"]).where("owner is not null")
    blocked = blocked.join(prio.withColumnRenamed("prio", "p_task"), ["dataset_id", "task_id"])
    blocked = blocked.join(prio.select("dataset_id", F.col("task_id").alias("owner"), F.col("prio").alias("p_owner")), ["dataset_id", "owner"]).where("p_task < p_owner")
    slices = in_window(t.slices, scope).join(prio, ["dataset_id", "task_id"]).select("dataset_id", "t_begin", "t_end", F.col("task_id").alias("m_task"), "slice_id", F.col("prio").alias("p_medium"), F.col("trusted").alias("m_trusted"))
    blocked = blocked.select("dataset_id", "seg_id", "task_id", "owner", "related_obj", "t_begin", "t_end", "clipped", "cause_event", "trusted", "p_task", "p_owner")
    pairs = overlap_join(blocked, slices, ["dataset_id"])
    return pairs.where("m_task <> task_id and m_task <> owner and p_medium > p_task and p_medium < p_owner")


def priority_inversion(t, scope: DataFrame) -> DataFrame:
    """``actual`` is the segment's own clipped blocked time."""
    g = preempting_slices(t, scope).groupBy("dataset_id", "seg_id", "task_id", "related_obj", "t_begin", "t_end", "clipped", "cause_event").agg(
        F.array_join(F.array_sort(F.collect_set("m_task")), ",").alias("others"),
        F.min(F.col("trusted") & F.col("m_trusted")).alias("trusted"),
    )
    return alert(g, "priority_inversion", F.col("seg_id"), task_id="task_id", obj_id="related_obj", other_tasks="others", threshold=F.lit(0), actual=F.col("clipped"), evidence=F.col("cause_event"), support_level=support(F.col("trusted")))


def irq_alerts(t, scope: DataFrame, th: Thresholds) -> DataFrame:
    s = clipped(t.irqs, scope).withColumn("ref", F.coalesce("enter_event", "exit_event"))
    long_ = s.where(F.col("clipped") >= th.long_irq)
    pressed = s.where((F.col("clipped") >= th.irq_latency) & F.col("delayed_task").isNotNull())
    common = {"irq_id": "irq_id", "core_id": "core_id", "actual": F.col("clipped"), "evidence": F.col("ref"), "support_level": support(F.col("trusted"))}
    return alert(long_, "long_irq", F.col("irq_span_id"), threshold=F.lit(th.long_irq), **common).unionByName(
        alert(pressed, "irq_pressure", F.col("irq_span_id"), task_id="delayed_task", threshold=F.lit(th.irq_latency), **common)
    )


def window_alerts(t, scope: DataFrame) -> DataFrame:
    return alert(in_window(t.windows, scope), "untrusted_window", F.col("window_id"), threshold=F.lit(0), actual=F.lit(1), evidence=F.col("window_id"), support_level=F.lit("degraded"))


def all_alerts(t, scope: DataFrame, th: Thresholds) -> DataFrame:
    return reduce(DataFrame.unionByName, [long_block(t, scope, th), deadline_miss(t, scope), deadline_gap(t, scope), priority_inversion(t, scope), irq_alerts(t, scope, th), window_alerts(t, scope)])


def diagnose(alerts: DataFrame) -> DataFrame:
    kind = F.col("type")
    text = (
        F.when(kind == "long_block", F.format_string("Task %d blocked longer than threshold", "task_id"))
        .when(kind == "long_irq", F.format_string("IRQ %d busy time exceeded threshold", "irq_id"))
        .when(kind == "priority_inversion", F.format_string("Task %d waited while tasks of medium priority %s ran", "task_id", "other_tasks"))
        .when(kind == "irq_pressure", F.format_string("IRQ %d delayed task %d beyond the latency threshold", "irq_id", "task_id"))
        .when(kind == "deadline_miss", F.format_string("Task %d missed its deadline; response %.3f of %.3f", "task_id", "actual", "threshold"))
        .when(kind == "deadline_semantics_gap", F.format_string("Deadlines can be rebuilt only in part; %.0f issues", "actual"))
        .otherwise(F.concat(F.lit("Trace confidence degraded by "), "evidence"))
    )
    confidence = F.when(F.col("support_level") == "exact", "high").when(F.col("support_level") == "unsupported", "low").otherwise("degraded")
    return alerts.select("dataset_id", F.concat(F.lit("diag:"), "alert_id").alias("diag_id"), kind.alias("title"), text.alias("conclusion"), confidence.alias("confidence"), "support_level", "alert_id", "evidence")


def backtrace(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts or diagnoses with the events that their evidence names."""
    return alerts.select("dataset_id", "alert_id", F.col("evidence").alias("event_uid")).join(events.select("dataset_id", "event_uid", "event_name", "ts", "core_id"), ["dataset_id", "event_uid"])
