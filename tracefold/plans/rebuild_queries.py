"""Registered queries: integrity windows, alignment and rebuilt intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..operators import align, integrity, rebuild
from ..sources import trace_view
from .sql import with_views
from .trace import TraceTables, over_trace

TRACE = {
    "i01_seq_gap_windows": lambda t: integrity.seq_gap_windows(t.raw),
    "i02_loss_overflow_windows": lambda t: integrity.loss_overflow_windows(t.raw),
    "i07_relation_windows": lambda t: rebuild.relation_windows(t.holds, t.waits, t.irqs),
    "i08_trust_tags": lambda t: t.tagged.select("event_uid", F.array_join("trust_tags", ",").alias("trust_tags"), "trusted"),
    "a01_align_offsets": lambda t: align.core_alignment(t.tagged),
    "a02_align_apply": lambda t: t.events.select("event_uid", "ts_raw", "ts", "covered"),
    "a03_align_degraded_window": lambda t: align.degraded_windows(t.events),
    "a04_event_order": lambda t: numbered(t.events.select("dataset_id", *align.ORDER, "event_uid"), "dataset_id", list(align.ORDER), "place", long=t.is_long).select("dataset_id", "event_uid", F.col("place").cast("int").alias("place")),
    "a05_dedupe_observations": lambda t: align.dedupe_observations(t.events.unionByName(t.events.where("seq % 5 = 0"))).select("event_uid", "ts"),
    "r01_task_state_segments": lambda t: t.states,
    "r02_exec_slices": lambda t: t.slices,
    "r03_dispatch_match": lambda t: rebuild.dispatch_matches(t.events),
    "r04_hold_edges": lambda t: t.holds,
    "r05_wait_edges": lambda t: t.waits,
    "r06_irq_spans": lambda t: t.irqs.drop("delayed_task"),
    "r07_irq_delayed_task": lambda t: t.irqs.select("irq_span_id", "t_end", "delayed_task"),
    "r08_ready_not_running": lambda t: _ready(t),
    "r09_node_counts": lambda t: rebuild.node_counts(t.events),
    "r09_hotspots": lambda t: rebuild.hotspots(t.events),
    "r10_capability_flags": lambda t: rebuild.capability_flags(t.events.withColumn("instance_id", F.when((F.col("event_name") == "TASK_EXIT") & (F.col("dataset_id").cast("long") % 2 == 1), F.col("seq")))),
    "r11_state_preview": lambda t: rebuild.state_preview(t.events),
    "i00_untrusted_windows": lambda t: t.windows,
}


#: One trace of all events, with nested interrupts, by cells of its keys.
LONG = {
    "r01_long_trace": ("r01_task_state_segments", lambda t: t.states),
    "r02_long_trace": ("r02_exec_slices", lambda t: t.slices),
    "r04_long_trace": ("r04_hold_edges", lambda t: t.holds),
    "r05_long_trace": ("r05_wait_edges", lambda t: t.waits),
    "r06_long_trace": (None, lambda t: t.irqs),
    "i01_long_trace": ("i01_seq_gap_windows", lambda t: integrity.seq_gap_windows(t.raw, t.is_long)),
}
WHOLE = 1 << 40  # events of a dataset


def over_one_trace(f):
    return lambda spark, sf_dir: f(TraceTables(trace_view.trace_events(spark, sf_dir, WHOLE, nested=True, long=True), long=True))


def _ready(t):
    r = rebuild.ready_not_running(t.states, t.slices, t.irqs)
    return r.withColumns({"slice_ids": F.array_join("slice_ids", ","), "irq_ids": F.array_join("irq_ids", ",")})


SQL = {
    "i01_seq_gap_windows": "SELECT * FROM gap_windows",
    "i02_loss_overflow_windows": "SELECT * FROM loss_windows",
    "i07_relation_windows": "SELECT * FROM relation_windows",
    "i08_trust_tags": "SELECT event_uid, array_to_string(trust_tags, ',') AS trust_tags, trusted FROM tagged",
    "a01_align_offsets": "SELECT * FROM cal",
    "a02_align_apply": "SELECT event_uid, ts_raw, ts, covered FROM al",
    "a03_align_degraded_window": "SELECT * FROM align_windows",
    "a04_event_order": "SELECT dataset_id, event_uid, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ts, core_id, seq) AS int) AS place FROM al",
    "a05_dedupe_observations": "SELECT DISTINCT event_uid, ts FROM al",
    "r01_task_state_segments": "SELECT * FROM states",
    "r02_exec_slices": "SELECT * FROM slices",
    "r03_dispatch_match": "SELECT dataset_id, event_uid, task_id, core_id, dispatch_event, dispatch_trusted FROM dispatches",
    "r04_hold_edges": "SELECT * FROM holds",
    "r05_wait_edges": "SELECT * FROM waits",
    "r06_irq_spans": "SELECT * EXCLUDE (delayed_task) FROM irqs",
    "r07_irq_delayed_task": "SELECT irq_span_id, t_end, delayed_task FROM irqs",
    "r08_ready_not_running": """SELECT r.dataset_id, 'ready:' || seg_id AS interval_id, task_id, t_begin, t_end,
  coalesce((SELECT string_agg(slice_id, ',' ORDER BY s.t_begin, s.core_id, s.task_id, slice_id) FROM slices AS s WHERE s.dataset_id = r.dataset_id AND s.task_id <> r.task_id AND s.t_begin <= r.t_end AND r.t_begin <= s.t_end), '') AS slice_ids,
  coalesce((SELECT string_agg(irq_span_id, ',' ORDER BY i.t_begin, i.core_id, irq_span_id) FROM irqs AS i WHERE i.dataset_id = r.dataset_id AND i.t_begin <= r.t_end AND r.t_begin <= i.t_end), '') AS irq_ids, trusted
  FROM states AS r WHERE state = 'READY'""",
    "r09_node_counts": "SELECT dataset_id, node, count(*) AS n FROM (SELECT dataset_id, 'task:' || task_id AS node FROM al UNION ALL SELECT dataset_id, 'obj:' || obj_id FROM al) AS x WHERE node IS NOT NULL GROUP BY ALL",
    "r09_hotspots": """SELECT * FROM (SELECT dataset_id, node, n, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, node) AS int) AS rank FROM (
  SELECT dataset_id, node, count(*) AS n FROM (SELECT dataset_id, 'task:' || task_id AS node FROM al UNION ALL SELECT dataset_id, 'obj:' || obj_id FROM al) AS x WHERE node IS NOT NULL GROUP BY ALL) AS y) AS z WHERE rank <= 10""",
    "r10_capability_flags": "SELECT dataset_id, bool_or(job_id IS NOT NULL) AS job_semantics, bool_or(deadline_ts IS NOT NULL) AS deadline_semantics, bool_or(event_name = 'TASK_EXIT' AND CAST(dataset_id AS bigint) % 2 = 1) AS instance_semantics FROM al GROUP BY dataset_id",
    "r11_state_preview": """SELECT dataset_id, bucket, count(*) FILTER (WHERE state = 'READY') AS ready, count(*) FILTER (WHERE state = 'RUNNING') AS running, count(*) FILTER (WHERE state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE state = 'EXIT') AS exit
  FROM (SELECT dataset_id, least(23, (ts - lo) * 24 // greatest(hi - lo, 1)) AS bucket, state FROM changes JOIN (SELECT dataset_id, min(ts) AS lo, max(ts) AS hi FROM al GROUP BY dataset_id) AS s USING (dataset_id)) AS x GROUP BY ALL""",
    "i00_untrusted_windows": "SELECT * FROM windows",
}
QUERIES = {k: over_trace(f) for k, f in TRACE.items()} | {k: over_one_trace(f) for k, (_, f) in LONG.items()}
ORACLE = {k: with_views(v) for k, v in SQL.items()} | {k: with_views(SQL.get(same, "SELECT * FROM irqs"), trace_view.sql(WHOLE, nested=True)) for k, (same, _) in LONG.items()}
