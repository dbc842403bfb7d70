"""Bucketed views, lanes, keyset pages, wait chains and other look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordering import neighbours
from .filters import clipped, in_window, switch_points
from .intervals import overlap_buckets, overlap_join
from .metrics import response_jitter, response_samples


def span_of(events: DataFrame) -> DataFrame:
    """The whole time range of each dataset, as a scope."""
    return events.groupBy("dataset_id").agg(F.min("ts").alias("w_begin"), F.max("ts").alias("w_end"))


def event_buckets(events: DataFrame, scope: DataFrame, n: int, *keys: str) -> DataFrame:
    e = in_window(events, scope)
    size = F.greatest((F.col("w_end") - F.col("w_begin")) / n, F.lit(1.0))
    b = F.least(F.lit(n - 1), F.floor((F.col("ts") - F.col("w_begin")) / size)).cast("int")
    return e.groupBy("dataset_id", b.alias("bucket"), *keys).agg(F.count("*").alias("events"))


def time_index(t, n: int = 128) -> DataFrame:
    """Events, slices and interrupt spans of each core per bucket of the whole trace."""
    scope = span_of(t.events)
    e = event_buckets(t.events, scope, n, "core_id").select("dataset_id", "bucket", "core_id", F.col("events").cast("double").alias("x"), F.lit("events").alias("kind"))
    for df, kind in ((t.slices, "slices"), (t.irqs, "irqs")):
        part = overlap_buckets(df.select("dataset_id", "core_id", "t_begin", "t_end"), scope, n)
        e = e.unionByName(part.select("dataset_id", "bucket", "core_id", F.col("part").alias("x"), F.lit(kind).alias("kind")))
    return e.groupBy("dataset_id", "bucket", "core_id").agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0)), 6).alias(k) for k in ("events", "slices", "irqs")])


def timeline_buckets(t, scope: DataFrame, n: int = 16) -> DataFrame:
    """Events, slices and interrupt spans per bucket; intervals count in proportion to overlap."""
    e = event_buckets(t.events, scope, n).select("dataset_id", "bucket", F.col("events").cast("double").alias("x"), F.lit("events").alias("kind"))
    parts = [overlap_buckets(df.select("dataset_id", "t_begin", "t_end"), scope, n).select("dataset_id", "bucket", F.col("part").alias("x"), F.lit(k).alias("kind")) for df, k in ((t.slices, "slices"), (t.irqs, "irqs"))]
    every = e.unionByName(parts[0]).unionByName(parts[1])
    return every.groupBy("dataset_id", "bucket").agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0)), 6).alias(k) for k in ("events", "slices", "irqs")])


def timeline_lod(t, scope: DataFrame, lod: int, limit: int = 200) -> DataFrame:
    """Level 0: buckets; 1: slices, switches and interrupts; 2: the first events of each dataset."""
    if lod == 0:
        return timeline_buckets(t, scope, 24)
    if lod == 1:
        rows = [in_window(df, scope).select("dataset_id", F.lit(k).alias("kind"), F.col(i).alias("id"), "t_begin", "t_end") for df, k, i in ((t.slices, "slice", "slice_id"), (t.irqs, "irq", "irq_span_id"))]
        sw = in_window(switch_points(t.events), scope).select("dataset_id", F.lit("switch").alias("kind"), F.col("event_uid").alias("id"), F.col("ts").alias("t_begin"), F.col("ts").alias("t_end"))
        return rows[0].unionByName(rows[1]).unionByName(sw)
    order = W.partitionBy("dataset_id").orderBy("ts", "core_id", "seq")
    return in_window(t.events, scope).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("dataset_id", "place", "event_uid", "event_name", "ts")


def state_lanes(t, scope: DataFrame, by: str = "task") -> DataFrame:
    """One row per lane: its segments in order, and counts per state. A lane is a task, or a task on the core of the cause event."""
    s = in_window(t.states, scope)
    lane = F.concat(F.lit("task:"), F.col("task_id").cast("string"))
    if by == "core":
        s = s.join(t.events.select("dataset_id", F.col("event_uid").alias("cause_event"), "core_id"), ["dataset_id", "cause_event"], "left")
        lane = F.concat(F.lit("core:"), F.col("core_id").cast("string"))
    s = s.withColumn("lane", lane)
    out = s.groupBy("dataset_id", "task_id", "lane").agg(
        F.array_sort(F.collect_list(F.struct("t_begin", "t_end", "seg_id", "state"))).alias("segments"),
        F.min("t_begin").alias("t_begin"),
        F.max("t_end").alias("t_end"),
        F.min("trusted").alias("trusted"),
        *[F.count_if(F.col("state") == x).alias(x.lower()) for x in ("READY", "RUNNING", "BLOCKED", "EXIT")],
    )
    return out


def event_page(events: DataFrame, cursors: DataFrame, limit: int = 100, forward: bool = True) -> DataFrame:
    """The page after (or before) each dataset's cursor (ts, core_id, seq), with has_more, the total on that side and the cursors of the pages around it (ts:core_id:seq).

    The limit on the row number is applied in every task before rows are
    shuffled, so a long trace doesn't meet in one.
    """
    key = F.struct("ts", "core_id", "seq")
    e = events.join(cursors.select("dataset_id", F.struct(F.col("ts").alias("ts"), F.col("core_id").alias("core_id"), F.col("seq").alias("seq")).alias("cursor")), "dataset_id")
    e = e.where(key > F.col("cursor") if forward else key < F.col("cursor"))
    order = [F.asc(c) if forward else F.desc(c) for c in ("ts", "core_id", "seq")]
    w = W.partitionBy("dataset_id").orderBy(*order)
    page = e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit + 1)
    totals = e.groupBy("dataset_id").agg(F.count("*").alias("total"))
    page = page.join(totals, "dataset_id").where(F.col("place") <= limit)
    name = F.concat_ws(":", "ts", "core_id", "seq")
    ends = page.groupBy("dataset_id").agg(F.min(F.struct("place", name.alias("c"))).alias("first"), F.max(F.struct("place", name.alias("c"))).alias("last"))
    more = F.col("total") > limit
    back, on = (F.col("first.c"), F.when(more, F.col("last.c"))) if forward else (F.when(more, F.col("last.c")), F.col("first.c"))
    return page.join(ends, "dataset_id").select("dataset_id", "place", "event_uid", "ts", "core_id", "seq", "trusted", more.alias("has_more"), "total", back.alias("prev_cursor"), on.alias("next_cursor"))


def index_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("dataset_id").agg(F.count("*").alias("events"), *[F.count_distinct(c).alias(n) for c, n in (("task_id", "tasks"), ("core_id", "cores"), ("event_name", "kinds"))])


def wait_chains(waits: DataFrame, holds: DataFrame) -> DataFrame:
    """Waiting task, object and holder: every hold of the object, or without any the wait's recorded owner."""
    h = holds.select("dataset_id", "obj_id", F.col("task_id").alias("holder"), F.col("evidence_ref").alias("hold_evidence"), F.col("trusted").alias("h_trusted"))
    w = waits.select("dataset_id", "obj_id", "task_id", "owner_task_id", F.col("evidence_ref").alias("wait_evidence"), F.col("trusted").alias("w_trusted"))
    j = w.join(h, ["dataset_id", "obj_id"], "left").where("holder is not null or owner_task_id is not null")
    return j.select("dataset_id", "task_id", "obj_id", F.coalesce("holder", "owner_task_id").alias("owner_task_id"), "wait_evidence", "hold_evidence", (F.col("w_trusted") & F.coalesce("h_trusted", F.lit(True))).alias("trusted"))


def chain_counts(waits: DataFrame, holds: DataFrame) -> DataFrame:
    """Per dataset: how many ``wait_chains`` there are, and different paths (task, object, owner) of them, from counts per object; no wait meets a hold."""
    key = ["dataset_id", "obj_id"]
    w = waits.groupBy(*key).agg(F.count("*").alias("n_w"), F.count_distinct("task_id").alias("t_w"), F.count("owner_task_id").alias("n_o"), F.count_distinct("task_id", "owner_task_id").alias("t_o"))
    h = holds.groupBy(*key).agg(F.count("*").alias("n_h"), F.count_distinct("task_id").alias("t_h"))
    held = F.col("n_h").isNotNull()
    paths = F.when(held, F.col("t_w") * F.col("t_h")).when(F.col("obj_id").isNotNull(), F.col("t_o")).otherwise(0)
    g = w.join(h, key, "left").groupBy("dataset_id").agg(F.sum(F.when(held, F.col("n_w") * F.col("n_h")).otherwise(F.col("n_o"))).alias("chains"), F.sum(paths).alias("paths"))
    return g.where("chains > 0")


def resource_graph(t, scope: DataFrame) -> DataFrame:
    """Per dataset: hold and wait edges, chains and nodes in the window."""
    holds, waits = in_window(t.holds, scope), in_window(t.waits, scope)
    counts = [
        holds.groupBy("dataset_id").agg(F.count("*").alias("hold_edges")),
        waits.groupBy("dataset_id").agg(F.count("*").alias("wait_edges")),
        chain_counts(waits, holds),
    ]
    out = t.scope.select("dataset_id")
    for c in counts:
        out = out.join(c, "dataset_id", "left")
    return out.na.fill(0)


def graph_nodes(t, scope: DataFrame, k: int = 5) -> DataFrame:
    """Nodes of the graph in the window: tasks and objects with the hold and wait edges they stand in, and their rank among the dataset's k busiest (null beyond)."""
    edges = in_window(t.holds, scope).unionByName(in_window(t.waits, scope))
    ends = F.array(F.concat(F.lit("task:"), F.col("task_id").cast("string")), F.concat(F.lit("obj:"), F.col("obj_id").cast("string")), F.concat(F.lit("task:"), F.when(~F.col("owner_task_id").eqNullSafe(F.col("task_id")), F.col("owner_task_id")).cast("string")))
    nodes = edges.select("dataset_id", "edge_kind", F.explode(F.array_distinct(F.array_compact(ends))).alias("node"))
    g = nodes.groupBy("dataset_id", "node").agg(F.count_if(F.col("edge_kind") == "hold").alias("holds"), F.count_if(F.col("edge_kind") == "wait").alias("waits"))
    place = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc(F.col("holds") + F.col("waits")), "node"))
    return g.withColumn("rank", F.when(place <= k, place))


def drilldown(t, scope: DataFrame, k: int = 3, margin: int = 20) -> DataFrame:
    """For each contended object: the k longest blocked segments on it, with the owner named by the blocking event, that owner's running time meanwhile, and the window to jump to."""
    s = clipped(t.states.where("state = 'BLOCKED' and related_obj is not null"), scope)
    w = W.partitionBy("dataset_id", "related_obj").orderBy(F.desc("clipped"), "t_begin", "seg_id")
    top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    cause = t.events.select("dataset_id", F.col("event_uid").alias("cause_event"), F.col("owner_task_id").alias("owner"), F.col("event_name").alias("cause_name"))
    top = top.join(cause, ["dataset_id", "cause_event"], "left").select("dataset_id", "related_obj", "rank", "seg_id", "task_id", "clipped", "t_begin", "t_end", "cause_event", "cause_name", "owner")
    met = overlap_join(top.where("owner is not null"), t.slices.select("dataset_id", F.col("task_id").alias("owner"), "t_begin", "t_end"), ["dataset_id", "owner"])
    ran = met.groupBy("dataset_id", "seg_id").agg(F.sum(F.least("t_end", "r_end") - F.greatest("t_begin", "r_begin")).alias("owner_ran"), F.count("*").alias("owner_slices"))
    out = top.join(ran, ["dataset_id", "seg_id"], "left").na.fill(0, ["owner_ran", "owner_slices"])
    return out.select("dataset_id", F.col("related_obj").alias("obj_id"), "rank", "seg_id", "task_id", "clipped", "cause_event", "cause_name", "owner", "owner_ran", "owner_slices", F.greatest(F.lit(0), F.col("t_begin") - margin).alias("jump_begin"), (F.col("t_end") + margin).alias("jump_end"))


def drilldown_events(t, scope: DataFrame, margin: int = 20, k: int = 10) -> DataFrame:
    """For each contended object: its first k hold and wait events in the window, each with a window to jump to."""
    e = in_window(t.events, scope).where("event_name in ('SYNC_LOCK', 'SYNC_UNLOCK', 'SYNC_TRY', 'TASK_BLOCK', 'TASK_WAKEUP') and obj_id is not null")
    w = W.partitionBy("dataset_id", "obj_id").orderBy("ts", "core_id", "seq")
    first = e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return first.select("dataset_id", "obj_id", "place", "event_uid", "event_name", "task_id", F.greatest(F.lit(0), F.col("ts") - margin).alias("jump_begin"), (F.col("ts") + margin).alias("jump_end"))


def widest_responses(states: DataFrame, scope: DataFrame) -> DataFrame:
    """Response samples of the task of each dataset whose responses differ most (the smallest task id of those)."""
    samples = response_samples(states, scope)
    jitter = response_jitter(states, scope).withColumn("n", F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("jitter"), "task_id"))).where("n = 1")
    return samples.join(jitter.select("dataset_id", "task_id"), ["dataset_id", "task_id"], "left_semi")


def metric_evidence(t, scope: DataFrame, k: int = 3) -> DataFrame:
    """The k rows that explain each metric best."""
    pick = lambda df, metric, ident, value: df.select("dataset_id", F.lit(metric).alias("metric_id"), F.col(ident).alias("ref"), F.col(value).cast("long").alias("value"))
    rows = [
        pick(clipped(t.slices, scope), "cpu_utilization", "slice_id", "clipped"),
        pick(clipped(t.states.where("state = 'BLOCKED'"), scope), "blocked_time", "seg_id", "clipped"),
        pick(clipped(t.states.where("state = 'READY'"), scope), "ready_wait_time", "seg_id", "clipped"),
        pick(response_samples(t.states, scope), "response_time", "seg_id", "response"),
        pick(clipped(t.irqs, scope), "irq_busy_time", "irq_span_id", "clipped"),
        pick(clipped(t.irqs, scope).where("delayed_task is not null"), "irq_latency", "irq_span_id", "clipped"),
        pick(widest_responses(t.states, scope), "response_jitter", "seg_id", "response"),
        pick(in_window(t.events, scope).where("event_name = 'CTX_SWITCH'").withColumn("early", -F.col("ts")), "context_switch_count", "event_uid", "early"),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    w = W.partitionBy("dataset_id", "metric_id").orderBy(F.desc("value"), "ref")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cause_events(states: DataFrame, events: DataFrame) -> DataFrame:
    """Segments with the name and core of the event that opened them."""
    return states.join(events.select("dataset_id", F.col("event_uid").alias("cause_event"), "event_name", "core_id"), ["dataset_id", "cause_event"], "left").select("seg_id", "event_name", "core_id")


def nearest_events(events: DataFrame, probes: DataFrame) -> DataFrame:
    """The event nearest to each probe time (dataset_id, at, probe); the earlier in order wins ties."""
    e = events.select("dataset_id", F.col("ts").alias("at"), F.struct("ts", "core_id", "seq", "event_uid").alias("e"))
    near = neighbours(probes.select("dataset_id", "at", "probe"), e, "dataset_id", "at", "e")
    pick = F.when(F.col("after").isNull() | (F.col("at") - F.col("before.ts") <= F.col("after.ts") - F.col("at")), F.col("before")).otherwise(F.col("after"))
    return near.select("dataset_id", "probe", F.coalesce(pick, "after")["event_uid"].alias("event_uid"))


def resolve_refs(refs: DataFrame, t) -> DataFrame:
    """refs (dataset_id, ref): an event, slice, segment or interrupt span, resolved to its events."""
    maps = [
        t.events.select("dataset_id", F.col("event_uid").alias("ref"), "event_uid"),
        t.slices.select("dataset_id", F.col("slice_id").alias("ref"), F.explode(F.array_compact(F.array("start_event", "end_event"))).alias("event_uid")),
        t.states.select("dataset_id", F.col("seg_id").alias("ref"), F.col("cause_event").alias("event_uid")),
        t.irqs.select("dataset_id", F.col("irq_span_id").alias("ref"), F.explode(F.array_compact(F.array("enter_event", "exit_event"))).alias("event_uid")),
    ]
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    return refs.join(every, ["dataset_id", "ref"]).distinct()
