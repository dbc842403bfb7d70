"""Registered queries: filters, metrics, alerts and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import filters as fl
from ..operators import metrics as m
from .sql import with_views
from .trace import over_trace

MINUTES = 60_000_000
TH = al.Thresholds(long_block=30 * MINUTES, long_irq=10 * MINUTES, irq_latency=5 * MINUTES)


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


TRACE = {
    "f01_window_filter": lambda t: fl.in_window(t.slices, t.scope).select("slice_id", "t_begin", "t_end"),
    "f02_scope_filter": lambda t: fl.scope_filter(t.states, {"task_id": 2, "resource_id": 0}).select("seg_id", "state"),
    "f02_scope_filter_missing": lambda t: fl.scope_filter(t.slices, {"irq_id": 1}).select("slice_id"),
    "f03_trusted_window": lambda t: fl.trusted_scopes(t.scope.unionByName(t.scope.select("dataset_id", "w_begin", F.expr("w_begin + 1").alias("w_end"))), t.windows.where("source = 'loss'")),
    "f04_clip_duration": lambda t: fl.clipped(t.states, t.scope).select("seg_id", "clipped"),
    "f05_capture_filter": lambda t: fl.capture_filter(t.raw, 0b0111, 0b0011, [1, 2, 3], [0, 1], True).select("event_uid"),
    "f06_systematic_sample": lambda t: fl.systematic_sample(t.raw, 2, 7).select("event_uid"),
    "f07_state_mask_filter": lambda t: fl.state_mask(t.states, ["BLOCKED", "EXIT"], [1, 2, 3]).select("seg_id", "state", "task_id"),
    "f08_switch_points": lambda t: fl.switch_points(t.events, 3),
    "f09_graph_filter": lambda t: fl.graph_filter(t.holds.unionByName(t.waits), task=2, obj=1).select("edge_kind", "task_id", "obj_id", "owner_task_id", "t_begin", "t_end"),
    "m01_cpu_utilization": lambda t: m.cpu_utilization(t.slices, t.scope),
    "m01_cpu_summary": lambda t: m.cpu_summary(t.slices, t.scope),
    "m02_blocked_time": lambda t: m.state_time(t.states, t.scope, "BLOCKED"),
    "m03_ready_wait_time": lambda t: m.state_time(t.states, t.scope, "READY"),
    "m04_response_time": lambda t: m.response_time(t.states, t.scope),
    "m05_response_jitter": lambda t: m.response_jitter(t.states, t.scope),
    "m06_deadline_miss": lambda t: m.deadline_status(t.events, t.scope),
    "m07_context_switch_count": lambda t: m.context_switches(t.events, t.scope),
    "m08_irq_busy_time": lambda t: m.irq_busy(t.irqs, t.scope),
    "m09_irq_latency": lambda t: m.irq_latency(t.irqs, t.scope),
    "m10_quantiles": lambda t: m.quantiles(fl.clipped(t.states.where("state = 'BLOCKED'"), t.scope), "clipped"),
    "m11_top_blocked": lambda t: m.ranked(m.state_time(t.states, t.scope, "BLOCKED"), "total", "task_id", 3).select("dataset_id", "task_id", "total", "rank"),
    "m12_metric_value": lambda t: m.metric_values(t, t.scope),
    "m13_metric_bucket_series": lambda t: m.bucket_series(t, t.scope, 2),
    "d01_deadline_analysis": lambda t: m.deadline_analysis(t.events, t.scope),
    "d02_support_level": lambda t: al.all_alerts(t, t.scope, TH).groupBy("dataset_id", "type", "support_level").agg(F.count("*").alias("n")),
    "d03_trust_summary": lambda t: m.trust_summary(t.windows, t.scope),
    "x01_long_block": lambda t: al.long_block(t, t.scope, TH),
    "x02_deadline_miss": lambda t: al.deadline_miss(t, t.scope),
    "x03_deadline_semantics_gap": lambda t: al.deadline_gap(t, t.scope),
    "x04_priority_inversion": lambda t: al.priority_inversion(t, t.scope).select("alert_id", "task_id", "obj_id", "other_tasks", "actual", "support_level"),
    "x05_irq_alerts": lambda t: al.irq_alerts(t, t.scope, TH),
    "x07_untrusted_window": lambda t: al.window_alerts(t, t.scope),
    "x08_diagnose": lambda t: al.diagnose(al.all_alerts(t, t.scope, TH)),
    "x09_backtrace": lambda t: al.backtrace(al.long_block(t, t.scope, TH), t.events),
}

CLIP = "greatest(0, least(t_end, w_end) - greatest(t_begin, w_begin))"
OPEN = "t_begin < w_end AND t_end > w_begin"
V = {
    "cs": f"SELECT *, {CLIP} AS clipped FROM slices JOIN scope USING (dataset_id) WHERE {OPEN}",
    "ct": f"SELECT *, {CLIP} AS clipped FROM states JOIN scope USING (dataset_id) WHERE {OPEN}",
    "ci": f"SELECT *, {CLIP} AS clipped, coalesce(enter_event, exit_event) AS ref FROM irqs JOIN scope USING (dataset_id) WHERE {OPEN}",
    "ce": "SELECT * FROM al JOIN scope USING (dataset_id) WHERE ts BETWEEN w_begin AND w_end",
    "cw": f"SELECT * FROM windows JOIN scope USING (dataset_id) WHERE {OPEN}",
    "samples": """SELECT * FROM (SELECT dataset_id, task_id, seg_id, t_end, state, t_end - t_begin AS response, lead(state) OVER (PARTITION BY dataset_id, task_id ORDER BY t_begin, t_end, seg_id) AS after FROM ct) AS x
  WHERE state = 'READY' AND after = 'RUNNING'""",
    "answers": """SELECT dataset_id, CAST(least(11, floor((t_end - w_begin) / greatest((w_end - w_begin) / 12, 1.0))) AS int) AS b, task_id, sum(response) AS s, count(*) AS k, max(response) - min(response) AS j FROM samples JOIN scope USING (dataset_id) GROUP BY ALL""",
    "dl1": """SELECT *, event_name = 'TASK_READY' AND (job_id IS NOT NULL OR coalesce(before <> 'TASK_READY', true)) AS accepted FROM (
  SELECT *, row_number() OVER w AS i, lag(event_name) OVER w AS before FROM ce WHERE event_name = 'TASK_EXIT' OR event_name = 'TASK_READY' AND deadline_ts IS NOT NULL
  WINDOW w AS (PARTITION BY dataset_id, task_id, job_id ORDER BY ts, core_id, seq)) AS x""",
    "dl2": "SELECT *, max(i) FILTER (WHERE accepted) OVER (PARTITION BY dataset_id, task_id, job_id) AS last_ready FROM dl1",
    "deadlines": """SELECT dataset_id, task_id, job_id, CASE WHEN job_id IS NULL THEN 'degraded' ELSE 'precise' END AS semantics, release_ts, deadline_ts, finish_ts,
  CASE WHEN finish_ts IS NOT NULL THEN greatest(0, finish_ts - release_ts) END AS response_time, CASE WHEN finish_ts IS NOT NULL THEN greatest(0, finish_ts - deadline_ts) END AS deadline_miss, conflicts, release_event
  FROM (SELECT dataset_id, task_id, job_id, max(ts) FILTER (WHERE i = last_ready) AS release_ts, max(deadline_ts) FILTER (WHERE i = last_ready) AS deadline_ts, max(event_uid) FILTER (WHERE i = last_ready) AS release_event,
    min_by(ts, i) FILTER (WHERE event_name = 'TASK_EXIT' AND i > last_ready) AS finish_ts, count(*) FILTER (WHERE event_name = 'TASK_READY' AND NOT accepted) AS conflicts, max(last_ready) AS n FROM dl2 GROUP BY ALL) AS x WHERE n IS NOT NULL""",
    "dstat": """SELECT dataset_id, miss_count, max_miss, records, incomplete, CAST(conflicts AS bigint) AS conflicts, CASE WHEN records > 0 AND incomplete + conflicts + imprecise = 0 THEN 'precise' WHEN records + incomplete + conflicts > 0 THEN 'degraded' ELSE 'unsupported' END AS semantics_status
  FROM (SELECT dataset_id, count(*) FILTER (WHERE deadline_miss > 0) AS miss_count, coalesce(max(deadline_miss), 0) AS max_miss, count(finish_ts) AS records, count(*) FILTER (WHERE finish_ts IS NULL) AS incomplete, sum(conflicts) AS conflicts,
    count(*) FILTER (WHERE finish_ts IS NOT NULL AND semantics <> 'precise') AS imprecise FROM deadlines GROUP BY dataset_id) AS x""",
    "cpu": "SELECT dataset_id, CAST(sum(clipped) AS bigint) AS total_run_time, count(DISTINCT core_id) AS core_count, round(sum(clipped) / any_value(greatest(w_end - w_begin, 1)), 6) AS avg_utilization FROM cs GROUP BY dataset_id",
    "prios": "SELECT dataset_id, task_id, max_by(prio, (ts, core_id, seq)) AS prio FROM ce WHERE prio IS NOT NULL GROUP BY ALL",
    "inverted": """SELECT b.dataset_id, b.seg_id, b.task_id, b.related_obj, b.clipped, b.t_begin, b.t_end, b.cause_event, b.trusted, s.task_id AS m_task, s.trusted AS m_trusted FROM ct AS b JOIN al AS c ON c.event_uid = b.cause_event
  JOIN prios AS p ON p.dataset_id = b.dataset_id AND p.task_id = b.task_id JOIN prios AS o ON o.dataset_id = b.dataset_id AND o.task_id = c.owner_task_id
  JOIN cs AS s ON s.dataset_id = b.dataset_id AND s.t_begin < b.t_end AND b.t_begin < s.t_end JOIN prios AS q ON q.dataset_id = s.dataset_id AND q.task_id = s.task_id
  WHERE b.state = 'BLOCKED' AND b.related_obj IS NOT NULL AND c.owner_task_id IS NOT NULL AND p.prio < q.prio AND q.prio < o.prio AND s.task_id <> b.task_id AND s.task_id <> c.owner_task_id""",
}
N = "CAST(NULL AS bigint)"
S = "CASE WHEN trusted THEN 'exact' ELSE 'degraded' END"
V["a1"] = f"""SELECT dataset_id, 'alert:long_block:' || seg_id AS alert_id, 'long_block' AS type, 'warning' AS severity, t_begin, t_end, task_id, related_obj AS obj_id, {N} AS irq_id, CAST(NULL AS int) AS core_id, CAST(NULL AS varchar) AS other_tasks,
  CAST({TH.long_block} AS double) AS threshold, CAST(clipped AS double) AS actual, cause_event AS evidence, {S} AS support_level FROM ct WHERE state = 'BLOCKED' AND clipped >= {TH.long_block}"""
V["a2"] = f"""SELECT dataset_id, 'alert:deadline_miss:' || dataset_id || ':' || task_id || ':' || release_event, 'deadline_miss' AS type, 'warning', release_ts, finish_ts, task_id, {N}, {N}, CAST(NULL AS int), CAST(NULL AS varchar),
  CAST(greatest(0, deadline_ts - release_ts) AS double), CAST(response_time AS double), release_event, CASE WHEN semantics = 'precise' THEN 'exact' ELSE 'degraded' END FROM deadlines WHERE deadline_miss > 0"""
V["a3"] = f"""SELECT dataset_id, 'alert:deadline_semantics_gap:' || dataset_id, 'deadline_semantics_gap', 'warning', w_begin, w_end, {N}, {N}, {N}, CAST(NULL AS int), CAST(NULL AS varchar), 0.0::double, CAST(incomplete + conflicts AS double), CAST(NULL AS varchar), 'degraded'
  FROM dstat JOIN scope USING (dataset_id) WHERE incomplete + conflicts > 0"""
V["a4"] = f"""SELECT dataset_id, 'alert:priority_inversion:' || seg_id, 'priority_inversion', 'warning', t_begin, t_end, task_id, related_obj, {N}, CAST(NULL AS int), string_agg(DISTINCT CAST(m_task AS varchar), ',' ORDER BY CAST(m_task AS varchar)), 0.0::double,
  CAST(clipped AS double), cause_event, CASE WHEN bool_and(trusted AND m_trusted) THEN 'exact' ELSE 'degraded' END FROM inverted GROUP BY dataset_id, seg_id, task_id, related_obj, t_begin, t_end, clipped, cause_event"""
V["a5"] = f"""SELECT dataset_id, 'alert:long_irq:' || irq_span_id, 'long_irq', 'warning', t_begin, t_end, {N}, {N}, irq_id, core_id, CAST(NULL AS varchar), CAST({TH.long_irq} AS double), CAST(clipped AS double), ref, {S} FROM ci WHERE clipped >= {TH.long_irq}"""
V["a6"] = f"""SELECT dataset_id, 'alert:irq_pressure:' || irq_span_id, 'irq_pressure', 'warning', t_begin, t_end, delayed_task, {N}, irq_id, core_id, CAST(NULL AS varchar), CAST({TH.irq_latency} AS double), CAST(clipped AS double), ref, {S} FROM ci WHERE clipped >= {TH.irq_latency} AND delayed_task IS NOT NULL"""
V["a7"] = f"""SELECT dataset_id, 'alert:untrusted_window:' || window_id, 'untrusted_window', 'warning', t_begin, t_end, {N}, {N}, {N}, CAST(NULL AS int), CAST(NULL AS varchar), 0.0::double, 1.0::double, window_id, 'degraded' FROM cw"""
V["alerts"] = " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(1, 8))

SQL = {
    "f01_window_filter": "SELECT slice_id, t_begin, t_end FROM cs",
    "f02_scope_filter": "SELECT seg_id, state FROM states WHERE task_id = 2 AND related_obj = 0",
    "f02_scope_filter_missing": "SELECT slice_id FROM slices WHERE false",
    "f03_trusted_window": f"""SELECT * FROM (SELECT * FROM scope UNION ALL SELECT dataset_id, w_begin, w_begin + 1 FROM scope) AS s
  WHERE NOT EXISTS (SELECT 1 FROM windows AS w WHERE w.dataset_id = s.dataset_id AND source = 'loss' AND w.t_begin < s.w_end AND w.t_end > s.w_begin)""",
    "f04_clip_duration": "SELECT seg_id, clipped FROM ct",
    "f05_capture_filter": "SELECT event_uid FROM ev WHERE core_id < 3 AND event_name NOT IN ('SYNC_CALIB', 'TS_CALIB', 'LOSS', 'OVERFLOW') AND event_name NOT LIKE 'IRQ%' AND coalesce(task_id IN (1, 2, 3), true) AND coalesce(obj_id IN (0, 1), true)",
    "f06_systematic_sample": "SELECT event_uid FROM (SELECT event_uid, row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY seq) AS n FROM ev) AS x WHERE (n - 1) % 7 < 2",
    "f07_state_mask_filter": "SELECT seg_id, state, task_id FROM states WHERE state IN ('BLOCKED', 'EXIT') AND task_id IN (1, 2, 3)",
    "f08_switch_points": "SELECT dataset_id, event_uid, core_id, ts, prev_task_id, next_task_id, reason, trusted FROM al WHERE event_name = 'CTX_SWITCH' AND 3 IN (prev_task_id, next_task_id)",
    "f09_graph_filter": "SELECT edge_kind, task_id, obj_id, owner_task_id, t_begin, t_end FROM (SELECT * FROM holds UNION ALL SELECT * FROM waits) AS e WHERE (task_id = 2 OR owner_task_id = 2) AND obj_id = 1",
    "m01_cpu_utilization": "SELECT dataset_id, core_id, CAST(sum(clipped) AS bigint) AS run_time, round(sum(clipped) / any_value(greatest(w_end - w_begin, 1)), 6) AS utilization FROM cs GROUP BY dataset_id, core_id",
    "m01_cpu_summary": "SELECT * FROM cpu",
    "m02_blocked_time": "SELECT dataset_id, task_id, CAST(sum(clipped) AS bigint) AS total, max(clipped) AS longest, count(*) AS segments FROM ct WHERE state = 'BLOCKED' GROUP BY ALL",
    "m03_ready_wait_time": "SELECT dataset_id, task_id, CAST(sum(clipped) AS bigint) AS total, max(clipped) AS longest, count(*) AS segments FROM ct WHERE state = 'READY' GROUP BY ALL",
    "m04_response_time": "SELECT dataset_id, task_id, round(avg(response), 6) AS avg_response, max(response) AS max_response, count(*) AS samples FROM samples GROUP BY ALL",
    "m05_response_jitter": "SELECT dataset_id, task_id, max(response) - min(response) AS jitter FROM samples GROUP BY ALL",
    "m06_deadline_miss": "SELECT * FROM dstat",
    "m07_context_switch_count": "SELECT dataset_id, count(*) FILTER (WHERE event_name = 'CTX_SWITCH') AS switches FROM ce GROUP BY dataset_id",
    "m08_irq_busy_time": "SELECT dataset_id, core_id, CAST(sum(clipped) AS bigint) AS busy_time, count(*) AS irq_count FROM ci GROUP BY ALL",
    "m09_irq_latency": "SELECT dataset_id, delayed_task, CAST(sum(clipped) AS bigint) AS total_latency, max(clipped) AS max_latency, count(*) AS spans FROM ci WHERE delayed_task IS NOT NULL GROUP BY ALL",
    "m10_quantiles": "SELECT dataset_id, round(quantile_cont(clipped, 0.5), 6) AS p50, round(quantile_cont(clipped, 0.9), 6) AS p90, round(quantile_cont(clipped, 0.95), 6) AS p95, round(quantile_cont(clipped, 0.99), 6) AS p99, count(*) AS n FROM ct WHERE state = 'BLOCKED' GROUP BY dataset_id",
    "m11_top_blocked": "SELECT * FROM (SELECT dataset_id, task_id, total, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY total DESC, task_id) AS int) AS rank FROM (SELECT dataset_id, task_id, CAST(sum(clipped) AS bigint) AS total FROM ct WHERE state = 'BLOCKED' GROUP BY ALL) AS x) AS y WHERE rank <= 3",
    "m12_metric_value": """SELECT dataset_id, 'cpu_utilization' AS metric_id, avg_utilization AS value FROM cpu
  UNION ALL SELECT dataset_id, 'blocked_time', CAST(sum(clipped) AS double) FROM ct WHERE state = 'BLOCKED' GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'ready_wait_time', CAST(sum(clipped) AS double) FROM ct WHERE state = 'READY' GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'response_time', round(avg(response), 6) FROM samples GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'response_jitter', CAST(max(jitter) AS double) FROM (SELECT dataset_id, task_id, max(response) - min(response) AS jitter FROM samples GROUP BY ALL) AS j GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'deadline_miss', CAST(max_miss AS double) FROM dstat
  UNION ALL SELECT dataset_id, 'context_switch_count', CAST(count(*) FILTER (WHERE event_name = 'CTX_SWITCH') AS double) FROM ce GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'irq_busy_time', CAST(sum(clipped) AS double) FROM ci GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 'irq_latency', CAST(sum(clipped) AS double) FROM ci WHERE delayed_task IS NOT NULL GROUP BY dataset_id""",
    "m13_metric_bucket_series": """SELECT dataset_id, CAST(b AS int) AS bucket, metric_id, CASE WHEN metric_id = 'cpu_utilization' THEN round(sum(t) / any_value(size), 6) ELSE round(sum(t), 2) END AS value FROM (
  SELECT *, greatest(0.0, least(t_end, w_begin + (b + 1) * size) - greatest(t_begin, w_begin + b * size)) / (t_end - t_begin) * (t_end - t_begin) AS t
  FROM (SELECT *, greatest((w_end - w_begin) / 12, 1.0) AS size, CAST(greatest(0, least(11, floor((t_begin - w_begin) / greatest((w_end - w_begin) / 12, 1.0)))) AS int) AS b0, CAST(greatest(0, least(11, floor((t_end - w_begin) / greatest((w_end - w_begin) / 12, 1.0)))) AS int) AS b1
    FROM (SELECT dataset_id, t_begin, t_end, 'cpu_utilization' AS metric_id FROM slices UNION ALL SELECT dataset_id, t_begin, t_end, CASE state WHEN 'READY' THEN 'ready_wait_time' ELSE 'blocked_time' END FROM states WHERE state IN ('BLOCKED', 'READY')
      UNION ALL SELECT dataset_id, t_begin, t_end, 'irq_busy_time' FROM irqs UNION ALL SELECT dataset_id, t_begin, t_end, 'irq_latency' FROM irqs WHERE delayed_task IS NOT NULL) AS i JOIN scope USING (dataset_id)
    WHERE t_end > t_begin AND t_begin <= w_end AND t_end >= w_begin) AS x, unnest(range(b0, b1 + 1)) AS u(b)) AS y GROUP BY dataset_id, b, metric_id
  UNION ALL SELECT dataset_id, CAST(least(11, floor((ts - w_begin) / greatest((w_end - w_begin) / 12, 1.0))) AS int) AS b, 'context_switch_count', CAST(count(*) AS double) FROM ce WHERE event_name = 'CTX_SWITCH' GROUP BY ALL
  UNION ALL SELECT dataset_id, b, 'response_time', round(sum(s) / sum(k), 3) FROM answers GROUP BY ALL UNION ALL SELECT dataset_id, b, 'response_jitter', CAST(max(j) AS double) FROM answers GROUP BY ALL
  UNION ALL SELECT dataset_id, CAST(least(11, floor((finish_ts - w_begin) / greatest((w_end - w_begin) / 12, 1.0))) AS int) AS b, 'deadline_miss', CAST(max(deadline_miss) AS double) FROM deadlines JOIN scope USING (dataset_id) WHERE finish_ts IS NOT NULL GROUP BY ALL""",
    "d01_deadline_analysis": "SELECT * FROM deadlines",
    "d02_support_level": "SELECT dataset_id, type, support_level, count(*) AS n FROM alerts GROUP BY ALL",
    "d03_trust_summary": "SELECT dataset_id, reason_code, count(*) AS n FROM cw GROUP BY ALL",
    "x01_long_block": "SELECT * FROM a1",
    "x02_deadline_miss": "SELECT * FROM alerts WHERE type = 'deadline_miss'",
    "x03_deadline_semantics_gap": "SELECT * FROM alerts WHERE type = 'deadline_semantics_gap'",
    "x04_priority_inversion": "SELECT alert_id, task_id, obj_id, other_tasks, actual, support_level FROM alerts WHERE type = 'priority_inversion'",
    "x05_irq_alerts": "SELECT * FROM alerts WHERE type IN ('long_irq', 'irq_pressure')",
    "x07_untrusted_window": "SELECT * FROM alerts WHERE type = 'untrusted_window'",
    "x08_diagnose": """SELECT dataset_id, 'diag:' || alert_id AS diag_id, type AS title, CASE type WHEN 'long_block' THEN 'Task ' || task_id || ' blocked longer than threshold' WHEN 'long_irq' THEN 'IRQ ' || irq_id || ' busy time exceeded threshold'
    WHEN 'priority_inversion' THEN 'Task ' || task_id || ' waited while tasks of medium priority ' || other_tasks || ' ran' WHEN 'irq_pressure' THEN 'IRQ ' || irq_id || ' delayed task ' || task_id || ' beyond the latency threshold'
    WHEN 'deadline_miss' THEN 'Task ' || task_id || ' missed its deadline; response ' || format('{:.3f}', actual) || ' of ' || format('{:.3f}', threshold)
    WHEN 'deadline_semantics_gap' THEN 'Deadlines can be rebuilt only in part; ' || CAST(CAST(actual AS bigint) AS varchar) || ' issues' ELSE 'Trace confidence degraded by ' || evidence END AS conclusion,
  CASE support_level WHEN 'exact' THEN 'high' WHEN 'unsupported' THEN 'low' ELSE 'degraded' END AS confidence, support_level, alert_id, evidence FROM alerts""",
    "x09_backtrace": "SELECT a.dataset_id, e.event_uid, alert_id, event_name, ts, e.core_id FROM a1 AS a JOIN al AS e ON e.event_uid = a.evidence",
}
#: Queries that read some interval tables more than once.
REREAD = {"m12_metric_value", "m13_metric_bucket_series", "d02_support_level", "d03_trust_summary", "x07_untrusted_window", "x08_diagnose"}
QUERIES = {k: over_trace(f, keep=k in REREAD) for k, f in TRACE.items()}
ORACLE = {k: with_views(v, V) for k, v in SQL.items()}
