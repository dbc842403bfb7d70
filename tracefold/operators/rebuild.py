"""Point events to intervals: task states, execution slices, hold and wait edges, interrupt spans.

All input is aligned events (``ts``, ``trusted``). Every rule takes a few
values from the rows before and behind within one key (task, core, or task and
object) of one dataset, by ``functions.scans``: windows where keys are short,
cells of a key where one trace is long (``long``; looked up where it is null).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scans import is_long, scan
from ..functions.tables import settle
from .intervals import overlap_join

SORT = ("ts", "core_id", "seq")
CORE, PLACE = ["dataset_id", "core_id"], ["ts", "seq"]


def dataset_end(events: DataFrame) -> DataFrame:
    return events.groupBy("dataset_id").agg(F.max("ts").alias("end_ts"))


def task_states(events: DataFrame, long: bool | None = None) -> DataFrame:
    """dataset_id, seg_id, task_id, state, t_begin, t_end, cause_event, related_obj, trusted.

    A switch sets its previous task READY only if that task is running, which
    is so exactly if the task's preceding row is an unconditional RUNNING.
    """
    row = lambda task, state, cond, sub: F.struct(task.cast("long").alias("task_id"), F.lit(state).alias("state"), F.lit(cond).alias("cond"), F.lit(sub).alias("sub"))
    name = F.col("event_name")
    simple = F.when(name == "TASK_READY", "READY").when(name == "TASK_BLOCK", "BLOCKED").when(name == "TASK_WAKEUP", "READY").when(name == "TASK_EXIT", "EXIT")
    changes = (
        F.when(name == "CTX_SWITCH", F.array(F.when(F.col("prev_task_id") != 0, row(F.col("prev_task_id"), "READY", True, 0)), F.when(F.col("next_task_id") != 0, row(F.col("next_task_id"), "RUNNING", False, 1))))
        .when(simple.isNotNull(), F.array(F.struct(F.col("task_id"), simple.alias("state"), F.lit(False).alias("cond"), F.lit(0).alias("sub"))))
    )
    rows = events.select("dataset_id", "ts", "core_id", "seq", "event_uid", "trusted", F.when(name.isin("TASK_BLOCK", "TASK_WAKEUP"), F.col("obj_id")).alias("related_obj"), F.explode(F.array_compact(changes)).alias("c"))
    rows = rows.select("*", "c.*").drop("c")
    task, order = ["dataset_id", "task_id"], [*SORT, "sub"]
    long = is_long(rows, task) if long is None else long
    rows = scan(rows, task, order, lag={"before": F.when(~F.col("cond"), F.col("state"))}, long=long)
    rows = rows.where("not cond or coalesce(before = 'RUNNING', false)")
    rows = scan(rows, task, order, lead={"next_ts": F.col("ts")}, number="n", long=long).join(dataset_end(events), "dataset_id")
    return rows.select(
        "dataset_id",
        F.concat_ws(":", F.lit("seg"), "dataset_id", "task_id", "n").alias("seg_id"),
        "task_id",
        "state",
        F.col("ts").alias("t_begin"),
        F.coalesce("next_ts", "end_ts").alias("t_end"),
        F.col("event_uid").alias("cause_event"),
        "related_obj",
        "trusted",
    )


def dispatch_matches(events: DataFrame, long: bool | None = None) -> DataFrame:
    """Each switch-in with the last dispatch of its task on its core since the previous switch-in (null if none)."""
    e = events.where("event_name = 'TASK_DISPATCH' or event_name = 'CTX_SWITCH' and next_task_id <> 0")
    pending = F.when(F.col("event_name") == "TASK_DISPATCH", F.struct(F.col("event_uid").alias("uid"), "trusted"))
    return scan(e, ["dataset_id", "task_id", "core_id"], PLACE, lag={"d": pending}, long=long).where("event_name = 'CTX_SWITCH'").select("dataset_id", "event_uid", "task_id", "core_id", F.col("d.uid").alias("dispatch_event"), F.col("d.trusted").alias("dispatch_trusted"))


def exec_slices(events: DataFrame, long: bool | None = None) -> DataFrame:
    """dataset_id, slice_id, task_id, core_id, t_begin, t_end, start_event, end_event, preempted_by, run_reason, trusted."""
    s = events.where("event_name = 'CTX_SWITCH'").select("dataset_id", "core_id", "ts", "seq", "event_uid", "next_task_id", "job_id", "reason", "trusted")
    long = is_long(s, CORE) if long is None else long
    s = scan(s, CORE, PLACE, lead={f"close_{c}": F.col(c) for c in ("ts", "event_uid", "next_task_id", "reason", "trusted")}, long=long)
    s = scan(s.where("next_task_id <> 0"), CORE, PLACE, number="n", long=long).join(dataset_end(events), "dataset_id")
    s = s.join(dispatch_matches(events, long).select("dataset_id", "event_uid", "dispatch_event", "dispatch_trusted"), ["dataset_id", "event_uid"])
    return s.select(
        "dataset_id",
        F.concat_ws(":", F.lit("slice"), "dataset_id", "core_id", "n").alias("slice_id"),
        F.col("next_task_id").alias("task_id"),
        "core_id",
        F.col("ts").alias("t_begin"),
        F.coalesce("close_ts", "end_ts").alias("t_end"),
        F.col("event_uid").alias("start_event"),
        F.col("close_event_uid").alias("end_event"),
        F.nullif("close_next_task_id", F.lit(0)).alias("preempted_by"),
        F.col("close_reason").alias("run_reason"),
        (F.col("trusted") & F.coalesce("dispatch_trusted", F.lit(True)) & F.coalesce("close_trusted", F.lit(True))).alias("trusted"),
        "dispatch_event",
    )


EDGE = ("dataset_id", "edge_kind", "task_id", "obj_id", "owner_task_id", "t_begin", "t_end", "evidence_ref", "end_event", "close_kind", "reason_code", "trusted")


def _edges(rows: DataFrame, ends: DataFrame, kind: str, open_name: str, close_name: str, missing: str, unmatched: str, long: bool | None) -> DataFrame:
    """rows: opens, closes and exits per (task, object); an open is ended by the next row of its key."""
    r = scan(rows, ["dataset_id", "task_id", "obj_id"], list(SORT), lag={"last_event_name": F.col("event_name")}, lead={f"next_{c}": F.col(c) for c in ("event_name", "ts", "event_uid", "trusted")}, long=long)
    after = F.col("next_event_name")
    close_kind = F.when(after.isNull(), "OPEN").when(after == open_name, "SUCCESSOR_OPEN").when(after == "TASK_EXIT", "TERMINAL_TASK_EXIT").otherwise("NORMAL")
    opened = r.where(F.col("event_name") == open_name).join(ends, "dataset_id")
    opened = opened.select(
        "dataset_id",
        F.lit(kind).alias("edge_kind"),
        "task_id",
        "obj_id",
        "owner_task_id",
        F.col("ts").alias("t_begin"),
        F.coalesce("next_ts", "end_ts").alias("t_end"),
        F.col("event_uid").alias("evidence_ref"),
        F.col("next_event_uid").alias("end_event"),
        close_kind.alias("close_kind"),
        F.when(close_kind != "NORMAL", missing).alias("reason_code"),
        (F.col("trusted") & F.coalesce("next_trusted", F.lit(True))).alias("trusted"),
    )
    # a close that no row of its fan-out matches stands alone
    matched = F.coalesce(F.col("last_event_name") == open_name, F.lit(False))
    lone = r.where(F.col("event_name") == close_name).groupBy("dataset_id", "event_uid").agg(F.max(matched).alias("matched"), *[F.first(c).alias(c) for c in ("task_id", "own_obj", "ts", "trusted", "owner_task_id")])
    lone = lone.where("not matched").select(
        "dataset_id",
        F.lit(kind).alias("edge_kind"),
        "task_id",
        F.col("own_obj").alias("obj_id"),
        F.col("task_id" if kind == "hold" else "owner_task_id").alias("owner_task_id"),
        F.col("ts").alias("t_begin"),
        F.col("ts").alias("t_end"),
        F.col("event_uid").alias("evidence_ref"),
        F.lit(None).cast("string").alias("end_event"),
        F.lit("UNMATCHED").alias("close_kind"),
        F.lit(unmatched).alias("reason_code"),
        "trusted",
    )
    return opened.unionByName(lone)


def _relation_rows(events: DataFrame, open_name: str, close_name: str) -> DataFrame:
    """Opens and closes with an object, and exits and closes without one on every object the task ever opens."""
    e = events.where(F.col("event_name").isin(open_name, close_name, "TASK_EXIT"))
    e = e.select("dataset_id", "task_id", F.when(F.col("event_name") != "TASK_EXIT", F.col("obj_id")).alias("own_obj"), "owner_task_id", "event_name", "ts", "core_id", "seq", "event_uid", "trusted")
    e = e.where((F.col("event_name") != open_name) | F.col("own_obj").isNotNull())
    keys = e.where(F.col("event_name") == open_name).select("dataset_id", "task_id", F.col("own_obj").alias("obj_id")).distinct()
    named = e.where("own_obj is not null").withColumn("obj_id", F.col("own_obj"))
    spread = e.where("own_obj is null").join(keys, ["dataset_id", "task_id"], "left")
    return named.unionByName(spread)


def hold_edges(events: DataFrame, long: bool | None = None) -> DataFrame:
    rows = _relation_rows(events, "SYNC_LOCK", "SYNC_UNLOCK").withColumn("owner_task_id", F.col("task_id"))
    return _edges(rows, dataset_end(events), "hold", "SYNC_LOCK", "SYNC_UNLOCK", "LOCK_WITHOUT_UNLOCK", "UNLOCK_WITHOUT_LOCK", long)


def wait_edges(events: DataFrame, long: bool | None = None) -> DataFrame:
    rows = _relation_rows(events, "TASK_BLOCK", "TASK_WAKEUP")
    return _edges(rows, dataset_end(events), "wait", "TASK_BLOCK", "TASK_WAKEUP", "WAIT_WITHOUT_WAKEUP", "WAKEUP_WITHOUT_BLOCK", long)


IRQ_COLUMNS = ["dataset_id", "core_id", "irq_id", "nesting_depth", "t_begin", "t_end", "enter_event", "exit_event", "close_kind", "trusted"]


def _is_enter() -> Column:
    return F.col("event_name") == "IRQ_ENTER"


def _as_enter() -> Column:
    return F.when(_is_enter(), F.struct(*PLACE, "irq_id", "nesting_depth", "event_uid", "trusted"))


def _fits(enter: str) -> Column:
    """Whether an exit has the interrupt and depth of an enter."""
    return ~_is_enter() & F.coalesce((F.col(f"{enter}.irq_id") == F.col("irq_id")) & (F.col(f"{enter}.nesting_depth") == F.col("nesting_depth")), F.lit(False))


def _natural_pairs(rows: DataFrame, long: bool) -> DataFrame:
    """Adds kind and enter to open rows: NORMAL to exits and USED to enters that are sure to match, whatever the depth.

    A running height of enters less exits gives each row a level; on a level,
    enters and exits take turns, and an exit's natural mate is the enter before
    it. If a pair fits and so do all pairs within it, the stack at the exit has
    just that enter on top.
    """
    r = scan(rows, CORE, PLACE, total={"height": F.when(_is_enter(), 1).otherwise(-1)}, long=long)
    r = r.withColumn("level", F.col("height") + F.when(_is_enter(), 0).otherwise(1))
    r = scan(r, [*CORE, "level"], PLACE, lag={"mate": _as_enter()}, long=long)
    misfit = ~_is_enter() & F.col("mate").isNotNull() & ~_fits("mate")
    r = scan(r, CORE, PLACE, last={"misfit": F.when(misfit, F.struct(*PLACE))}, long=long)
    r = r.withColumn("sure", _fits("mate") & F.coalesce(F.col("misfit") < F.struct("mate.ts", "mate.seq"), F.lit(True)))
    r = scan(r, [*CORE, "level"], PLACE, lead={"used": F.col("sure")}, long=long)
    kind = F.when(F.col("sure"), "NORMAL").when(_is_enter() & F.col("used"), "USED")
    return r.select(*rows.columns, kind.alias("kind"), F.when(F.col("sure"), F.col("mate")).alias("enter"))


def _runs(rows: DataFrame, long: bool) -> DataFrame:
    """Adds kind and enter to open rows by runs of exits behind an open enter (or behind none).

    That enter is the top of the stack for the whole run, up to the first exit
    that fits: those before it stand alone, it matches, and those behind it wait.
    """
    r = settle(scan(rows, CORE, PLACE, last={"top": _as_enter()}, long=long))
    fits = r.where(_fits("top")).groupBy(*CORE, F.col("top.event_uid").alias("top_uid")).agg(F.min(F.struct(*PLACE)).alias("first"))
    exits = r.where(~_is_enter()).withColumn("top_uid", F.col("top.event_uid")).join(fits, [*CORE, "top_uid"], "left")
    here = F.struct(*PLACE)
    kind = F.when(F.col("first").isNull() | (here < F.col("first")), "UNMATCHED").when(here == F.col("first"), "NORMAL")
    exits = exits.select(*rows.columns, kind.alias("kind"), F.when(kind == "NORMAL", F.col("top")).alias("enter"))
    used = fits.select(*CORE, F.col("top_uid").alias("event_uid"), F.lit("USED").alias("kind"))
    enters = r.where(_is_enter()).select(*rows.columns).join(used, [*CORE, "event_uid"], "left").select(*rows.columns, "kind", F.lit(None).cast(exits.schema["enter"].dataType).alias("enter"))
    return exits.unionByName(enters)


def irq_spans(events: DataFrame, long: bool | None = None) -> DataFrame:
    """Interrupt spans with the task that ran on the core at their end as delayed_task.

    An exit matches the top of its core's stack if interrupt and depth agree;
    else it stands alone and the stack stays. Natural pairs settle all that is
    cleanly nested at once. What is left goes through rounds, each of which
    ends every open enter's run of exits on all cores and then pairs anew; every round
    settles at least the first open exit of each core, and only open rows go on.
    """
    irqs = events.where(F.col("event_name").isin("IRQ_ENTER", "IRQ_EXIT")).join(dataset_end(events), "dataset_id")
    irqs = irqs.select("dataset_id", "core_id", F.col("irq_id").cast("long").alias("irq_id"), F.col("nesting_depth").cast("int").alias("nesting_depth"), "event_name", "ts", "seq", "event_uid", "trusted", "end_ts")
    long = is_long(irqs, CORE) if long is None else long
    told = settle(_natural_pairs(irqs, long))
    parts = [told.where("kind is not null")]
    step, other = _runs, _natural_pairs
    while not (left := told.where("kind is null").drop("kind", "enter")).where(~_is_enter()).isEmpty():
        told = settle(step(left, long))
        parts.append(told.where("kind is not null"))
        step, other = other, step
    told = reduce(DataFrame.unionByName, [*parts, told.where("kind is null").withColumn("kind", F.lit("OPEN"))]).where("kind <> 'USED'")
    normal, alone = F.col("kind") == "NORMAL", F.col("kind") == "UNMATCHED"
    spans = told.select(
        "dataset_id",
        "core_id",
        "irq_id",
        "nesting_depth",
        F.when(normal, F.col("enter.ts")).otherwise(F.col("ts")).alias("t_begin"),
        F.when(normal | alone, F.col("ts")).otherwise(F.col("end_ts")).alias("t_end"),
        F.when(normal, F.col("enter.event_uid")).when(~alone, F.col("event_uid")).alias("enter_event"),
        F.when(normal | alone, F.col("event_uid")).alias("exit_event"),
        F.col("kind").alias("close_kind"),
        (F.col("trusted") & F.coalesce("enter.trusted", F.lit(True))).alias("trusted"),
        F.when(normal | alone, F.col("seq")).alias("exit_seq"),
    )
    return with_delayed_task(spans, events, long)


def with_delayed_task(spans: DataFrame, events: DataFrame, long: bool | None = None) -> DataFrame:
    """As-of join: the last task switched to on the core up to the span's exit (or the end of the trace; spans carry exit_seq)."""
    key = F.coalesce("enter_event", "exit_event")
    probe = spans.select(*CORE, F.col("t_end").alias("ts"), F.coalesce("exit_seq", F.lit(1 << 60)).alias("seq"), key.alias("tie"), F.struct(*IRQ_COLUMNS).alias("span"), F.lit(None).cast("long").alias("next_task_id"))
    switches = events.where("event_name = 'CTX_SWITCH'").select(*CORE, "ts", "seq", F.lit(None).cast("string").alias("tie"), F.lit(None).cast(probe.schema["span"].dataType).alias("span"), "next_task_id")
    both = scan(probe.unionByName(switches), CORE, [*PLACE, "tie"], last={"running": F.col("next_task_id")}, long=long)
    out = both.where("span is not null").select("span.*", F.nullif("running", F.lit(0)).alias("delayed_task"))
    return out.withColumn("irq_span_id", F.concat_ws(":", F.lit("irq"), "dataset_id", F.coalesce("enter_event", "exit_event")))


def relation_windows(holds: DataFrame, waits: DataFrame, irqs: DataFrame) -> DataFrame:
    """Untrusted windows of relations that lack their other end."""
    edges = holds.unionByName(waits).where("reason_code is not null").select("dataset_id", "reason_code", "t_begin", "t_end", F.col("evidence_ref").alias("key"))
    reason = F.when(F.col("close_kind") == "UNMATCHED", "IRQ_EXIT_WITHOUT_MATCHING_ENTER").when(F.col("close_kind") == "OPEN", "IRQ_ENTER_WITHOUT_EXIT")
    spans = irqs.select("dataset_id", reason.alias("reason_code"), "t_begin", "t_end", F.coalesce("enter_event", "exit_event").alias("key")).where("reason_code is not null")
    return edges.unionByName(spans).select(
        "dataset_id",
        F.concat_ws(":", F.lit("uw"), "dataset_id", "reason_code", "key").alias("window_id"),
        F.lit("relation").alias("source"),
        F.lit("object").alias("scope"),
        "t_begin",
        "t_end",
        "reason_code",
        F.lit("warning").alias("severity"),
    )


def ready_not_running(states: DataFrame, slices: DataFrame, irqs: DataFrame) -> DataFrame:
    """Each READY segment with the other tasks' slices and all interrupt spans that overlap it (closed ends), in order of time."""
    ready = states.where("state = 'READY'").select("dataset_id", "seg_id", F.col("task_id").alias("ready_task"), "t_begin", "t_end", "trusted")
    s = overlap_join(ready, slices.select("dataset_id", "t_begin", "t_end", "slice_id", "task_id", "core_id"), ["dataset_id"], closed=True)
    s = s.where("task_id <> ready_task").groupBy("dataset_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("r_begin", "core_id", "task_id", "slice_id"))).alias("s"))
    i = overlap_join(ready, irqs.select("dataset_id", "t_begin", "t_end", "irq_span_id", "core_id"), ["dataset_id"], closed=True)
    i = i.groupBy("dataset_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("r_begin", "core_id", "irq_span_id"))).alias("i"))
    out = ready.join(s, ["dataset_id", "seg_id"], "left").join(i, ["dataset_id", "seg_id"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "dataset_id",
        F.concat(F.lit("ready:"), "seg_id").alias("interval_id"),
        F.col("ready_task").alias("task_id"),
        "t_begin",
        "t_end",
        F.coalesce(F.transform("s", lambda x: x["slice_id"]), none).alias("slice_ids"),
        F.coalesce(F.transform("i", lambda x: x["irq_span_id"]), none).alias("irq_ids"),
        "trusted",
    )


def node_counts(events: DataFrame) -> DataFrame:
    """Events per node task:x and obj:x."""
    nodes = F.array_compact(F.array(F.concat(F.lit("task:"), F.col("task_id").cast("string")), F.concat(F.lit("obj:"), F.col("obj_id").cast("string"))))
    return events.select("dataset_id", F.explode(nodes).alias("node")).groupBy("dataset_id", "node").agg(F.count("*").alias("n"))


def hotspots(events: DataFrame, k: int = 10) -> DataFrame:
    ranked = node_counts(events).withColumn("rank", F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("n"), "node")))
    return ranked.where(F.col("rank") <= k)


def capability_flags(events: DataFrame) -> DataFrame:
    """Whether any event has a job, a deadline or an instance id; a column that the events don't have counts as empty."""
    some = lambda c: F.max(F.col(c).isNotNull()) if c in events.columns else F.lit(False)
    return events.groupBy("dataset_id").agg(some("job_id").alias("job_semantics"), some("deadline_ts").alias("deadline_semantics"), some("instance_id").alias("instance_semantics"))


def state_preview(events: DataFrame, buckets: int = 24) -> DataFrame:
    """Transitions per bucket and state without rebuilding; every switched-out task counts as READY."""
    name = F.col("event_name")
    simple = F.when(name.isin("TASK_READY", "TASK_WAKEUP"), "READY").when(name == "TASK_BLOCK", "BLOCKED").when(name == "TASK_EXIT", "EXIT")
    states = F.when(name == "CTX_SWITCH", F.array(F.when(F.col("prev_task_id") > 0, "READY"), F.when(F.col("next_task_id") > 0, "RUNNING"))).otherwise(F.array(F.when(F.col("task_id") > 0, simple)))
    span = events.groupBy("dataset_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = events.join(span, "dataset_id").select("dataset_id", F.least(F.lit(buckets - 1), F.expr(f"(ts - lo) * {buckets} div greatest(hi - lo, 1)")).alias("bucket"), F.explode(F.array_compact(states)).alias("state"))
    counts = rows.groupBy("dataset_id", "bucket").pivot("state", ["READY", "RUNNING", "BLOCKED", "EXIT"]).count()
    return counts.na.fill(0).select("dataset_id", "bucket", *[F.col(s).alias(s.lower()) for s in ("READY", "RUNNING", "BLOCKED", "EXIT")])
