"""Registered queries: buckets, lanes, pages, chains and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import compare as cp
from ..operators import index as ix
from ..operators import metrics as m
from ..operators import rebuild
from ..operators.intervals import overlap_buckets
from .metric_queries import OPEN, SQL as METRIC_SQL, TH, V as METRIC_VIEWS
from .sql import with_views
from .trace import over_trace


def _cursors(t):
    return t.scope.select("dataset_id", F.col("w_begin").alias("ts"), F.lit(1).alias("core_id"), F.lit(0).cast("long").alias("seq"))


def _reports(t, shift: int):
    r = t.events.groupBy("dataset_id").agg(F.count("*").alias("event_count"), F.min("ts").alias("first_timestamp"), F.max("core_id").alias("cores"))
    n = F.col("dataset_id").cast("long")
    return r if not shift else r.select("dataset_id", (F.col("event_count") + n % 2).alias("event_count"), F.when(n % 3 != 0, F.col("first_timestamp") + n % 2).alias("first_timestamp"), F.when(n != 1, F.col("cores")).alias("cores"))


TRACE = {
    "b01_overlap_buckets": lambda t: overlap_buckets(t.slices, ix.span_of(t.events), 32).groupBy("dataset_id", "bucket").agg(F.round(F.sum("part"), 6).alias("slices")),
    "b02_time_index": lambda t: ix.time_index(t),
    "b03_timeline_buckets": lambda t: ix.timeline_buckets(t, t.scope, 16),
    "b04_timeline_lod1": lambda t: ix.timeline_lod(t, t.scope, 1),
    "b04_timeline_lod2": lambda t: ix.timeline_lod(t, t.scope, 2, 50),
    "b05_preview_buckets": lambda t: ix.event_buckets(t.events, ix.span_of(t.events), 24),
    "b06_state_lanes": lambda t: ix.state_lanes(t, t.scope).withColumn("segments", F.array_join(F.transform("segments", lambda s: s["seg_id"]), ",")),
    "b06_state_lanes_core": lambda t: ix.state_lanes(t, t.scope, "core").withColumn("segments", F.size("segments")),
    "q01_event_page_forward": lambda t: ix.event_page(t.events, _cursors(t), 50, True),
    "q01_event_page_backward": lambda t: ix.event_page(t.events, _cursors(t), 50, False),
    "q03_index_summary": lambda t: ix.index_summary(t.events),
    "q04_resource_graph": lambda t: ix.resource_graph(t, t.scope),
    "q04_graph_nodes": lambda t: ix.graph_nodes(t, t.scope),
    "q05_resource_drilldown": lambda t: ix.drilldown(t, t.scope),
    "q05_drilldown_events": lambda t: ix.drilldown_events(t, t.scope),
    "q06_alerts_query": lambda t: al.all_alerts(t, t.scope, TH).where("task_id = 2").select("alert_id", "type"),
    "q09_metric_evidence": lambda t: ix.metric_evidence(t, t.scope),
    "j01_cause_event_join": lambda t: ix.cause_events(t.states, t.events),
    "j02_wait_chains": lambda t: ix.wait_chains(t.waits, t.holds),
    "j03_preempting_slices": lambda t: al.preempting_slices(t, t.scope).select("seg_id", "slice_id", "m_task"),
    "j09_last_priority_asof": lambda t: al.last_priorities(t.events, t.scope),
    "j10_nearest_event": lambda t: ix.nearest_events(t.events, t.scope.select("dataset_id", F.explode(F.expr("sequence(w_begin, w_end, greatest((w_end - w_begin) div 20, 1))")).alias("at")).withColumn("probe", F.col("at").cast("string"))),
    "j13_evidence_resolution": lambda t: ix.resolve_refs(al.irq_alerts(t, t.scope, TH).select("dataset_id", F.col("evidence").alias("ref")).unionByName(t.slices.where("t_end - t_begin > 0").select("dataset_id", F.col("slice_id").alias("ref"))), t),
    "p01_metric": lambda t: cp.metric(m.metric_values(t, t.scope), t.windows),
    "p02_alert": lambda t: cp.alert_change(al.all_alerts(t, t.scope, TH)),
    "p03_hotspot": lambda t: cp.hotspot(rebuild.node_counts(t.events), 5),
    "p04_interval": lambda t: cp.longest_block(t.states),
    "p05_task": lambda t: cp.top_changes(cp.task(t.slices, t.states), "d_blocked", "task_id"),
    "p06_core": lambda t: cp.core(t.slices, t.events),
    "p07_resource": lambda t: cp.resource(t.events, t.states),
    "p08_irq": lambda t: cp.irq(t.irqs),
    "p09_diff_detail": lambda t: cp.diff_detail(cp.detail_rows(t, t.alerts(TH), rebuild.hotspots(t.events))),
    "p11_summary_drift": lambda t: cp.field_drift(_reports(t, 0), _reports(t, 1), "dataset_id", ["event_count", "first_timestamp", "cores"]),
    "p12_fact_drift": lambda t: cp.fact_drift(_reports(t, 0), _reports(t, 1), "dataset_id", ["event_count", "first_timestamp", "cores"]),
    "p13_replay_invariants": lambda t: cp.replay_invariants(t.events),
}

SIZE = "greatest((w_end - w_begin) / {n}, 1.0)"


def parts(table: str, scope: str, n: int) -> str:
    """SQL: dataset_id, b, part of each interval of a table in n buckets of a scope."""
    z = SIZE.format(n=n)
    place = f"CAST(greatest(0, least({n - 1}, floor(({{}} - w_begin) / {z}))) AS int)"
    return f"""SELECT dataset_id, CAST(b AS int) AS bucket, CASE WHEN t_end <= t_begin THEN 1.0 ELSE greatest(0.0, least(t_end, w_begin + (b + 1) * size) - greatest(t_begin, w_begin + b * size)) / (t_end - t_begin) END AS part
  FROM (SELECT *, {z} AS size, {place.format('t_begin')} AS b0, {place.format('t_end')} AS b1 FROM {table} JOIN {scope} USING (dataset_id) WHERE t_begin <= w_end AND t_end >= w_begin) AS x, unnest(range(b0, b1 + 1)) AS u(b)"""


def core_parts(table: str) -> str:
    """SQL: parts of a table's intervals in 128 buckets of the whole trace, with their core."""
    return parts(table, "whole", 128).replace("SELECT dataset_id, CAST(b AS int)", "SELECT dataset_id, core_id, CAST(b AS int)", 1)


def bucket_of(n: int) -> str:
    return f"CAST(least({n - 1}, floor((ts - w_begin) / {SIZE.format(n=n)})) AS int)"


def outer_sql(table: str, keys: list[str], values: list[str], more: str = "") -> str:
    k = "".join(f", {x}" for x in keys)
    using = ", ".join(["pair", *keys])
    side = lambda r, p: f"SELECT CAST(dataset_id AS bigint) // 2 AS pair{k}, {', '.join(f'{v} AS {p}_{v}' for v in values)} FROM {table} WHERE CAST(dataset_id AS bigint) % 2 = {r}"
    cells = ", ".join(f"coalesce(b_{v}, 0) AS b_{v}, coalesce(c_{v}, 0) AS c_{v}, round(coalesce(c_{v}, 0) - coalesce(b_{v}, 0), 6) AS d_{v}" for v in values)
    return f"SELECT *{more} FROM (SELECT {using}, {cells} FROM ({side(0, 'b')}) AS b FULL JOIN ({side(1, 'c')}) AS c USING ({using})) AS o"


V = {
    **METRIC_VIEWS,
    "widest": "SELECT dataset_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY jitter DESC, task_id) AS n FROM (SELECT dataset_id, task_id, max(response) - min(response) AS jitter FROM samples GROUP BY dataset_id, task_id) AS x) AS y WHERE n = 1",
    "whole": "SELECT dataset_id, min(ts) AS w_begin, max(ts) AS w_end FROM al GROUP BY dataset_id",
    "sparts": parts("slices", "scope", 16),
    "iparts": parts("irqs", "scope", 16),
    "tb": f"""SELECT dataset_id, bucket, count(*) AS x, 'events' AS kind FROM (SELECT dataset_id, {bucket_of(16)} AS bucket FROM ce) AS x GROUP BY ALL
  UNION ALL SELECT dataset_id, bucket, sum(part), 'slices' FROM sparts GROUP BY ALL UNION ALL SELECT dataset_id, bucket, sum(part), 'irqs' FROM iparts GROUP BY ALL""",
    "mv": METRIC_SQL["m12_metric_value"],
    "codes": "SELECT CAST(dataset_id AS bigint) // 2 AS pair, CAST(dataset_id AS bigint) % 2 AS side, string_agg(DISTINCT reason_code, ',' ORDER BY reason_code) AS codes FROM windows GROUP BY ALL",
    "an": "SELECT dataset_id, type, severity, count(*) AS n FROM alerts GROUP BY ALL",
    "nodes": "SELECT dataset_id, node, count(*) AS n FROM (SELECT dataset_id, 'task:' || task_id AS node FROM al UNION ALL SELECT dataset_id, 'obj:' || obj_id FROM al) AS x WHERE node IS NOT NULL GROUP BY ALL",
    "hot": "SELECT DISTINCT CAST(dataset_id AS bigint) // 2 AS pair, node FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, node) AS r FROM nodes) AS x WHERE r <= 5",
    "lb": "SELECT dataset_id, max(t_end - t_begin) AS longest FROM states WHERE state = 'BLOCKED' GROUP BY dataset_id",
    "run_t": "SELECT dataset_id, task_id, CAST(sum(t_end - t_begin) AS bigint) AS runtime FROM slices GROUP BY ALL",
    "blk_t": "SELECT dataset_id, task_id, CAST(sum(t_end - t_begin) AS bigint) AS blocked FROM states WHERE state = 'BLOCKED' GROUP BY ALL",
    "tt": "SELECT * FROM run_t FULL JOIN blk_t USING (dataset_id, task_id)",
    "cc": "SELECT * FROM (SELECT dataset_id, core_id, CAST(sum(t_end - t_begin) AS bigint) AS runtime FROM slices GROUP BY ALL) AS a FULL JOIN (SELECT dataset_id, core_id, count(*) AS switches FROM al WHERE event_name = 'CTX_SWITCH' GROUP BY ALL) AS b USING (dataset_id, core_id)",
    "rr": "SELECT * FROM (SELECT dataset_id, obj_id, count(*) AS events FROM al WHERE obj_id IS NOT NULL GROUP BY ALL) AS a FULL JOIN (SELECT dataset_id, related_obj AS obj_id, CAST(sum(t_end - t_begin) AS bigint) AS blocked FROM states WHERE state = 'BLOCKED' AND related_obj IS NOT NULL GROUP BY ALL) AS b USING (dataset_id, obj_id)",
    "ii": "SELECT dataset_id, irq_id, CAST(sum(t_end - t_begin) AS bigint) AS busy, count(*) AS spans FROM irqs GROUP BY ALL",
    "hotnodes": """SELECT dataset_id, node FROM (SELECT dataset_id, node, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, node) AS r FROM (SELECT dataset_id, 'task:' || task_id AS node FROM al UNION ALL SELECT dataset_id, 'obj:' || obj_id FROM al) AS x WHERE node IS NOT NULL GROUP BY dataset_id, node) AS y WHERE r <= 10""",
    "shown": """SELECT dataset_id, 'metric' AS dimension, 'cpu_utilization' AS key, slice_id AS ref, t_begin, t_end, [start_event, end_event] AS ev FROM slices UNION ALL SELECT dataset_id, 'core', CAST(core_id AS varchar), slice_id, t_begin, t_end, [start_event, end_event] FROM slices
  UNION ALL SELECT dataset_id, 'metric', CASE state WHEN 'BLOCKED' THEN 'blocked_time' ELSE 'ready_wait_time' END, seg_id, t_begin, t_end, [cause_event] FROM states WHERE state IN ('BLOCKED', 'READY')
  UNION ALL SELECT dataset_id, 'metric', 'irq_busy_time', irq_span_id, t_begin, t_end, [enter_event, exit_event] FROM irqs UNION ALL SELECT dataset_id, 'metric', 'irq_latency', irq_span_id, t_begin, t_end, [enter_event, exit_event] FROM irqs WHERE delayed_task IS NOT NULL
  UNION ALL SELECT dataset_id, 'irq', CAST(irq_id AS varchar), irq_span_id, t_begin, t_end, [enter_event, exit_event] FROM irqs UNION ALL SELECT dataset_id, 'metric', 'context_switch_count', event_uid, ts, ts, [event_uid] FROM al WHERE event_name = 'CTX_SWITCH'
  UNION ALL SELECT dataset_id, 'alert', type, alert_id, t_begin, t_end, [evidence] FROM alerts UNION ALL SELECT dataset_id, 'hotspot', node, event_uid, ts, ts, [event_uid] FROM (SELECT dataset_id, event_uid, ts, unnest(['task:' || task_id, 'obj:' || obj_id]) AS node FROM al) AS n JOIN hotnodes USING (dataset_id, node)
  UNION ALL SELECT dataset_id, 'interval', 'max_blocked', seg_id, t_begin, t_end, [cause_event] FROM states WHERE state = 'BLOCKED' UNION ALL SELECT dataset_id, 'task', CAST(task_id AS varchar), seg_id, t_begin, t_end, [cause_event] FROM states WHERE state = 'BLOCKED' AND task_id IS NOT NULL
  UNION ALL SELECT dataset_id, 'resource', CAST(related_obj AS varchar), seg_id, t_begin, t_end, [cause_event] FROM states WHERE state = 'BLOCKED' AND related_obj IS NOT NULL""",
    "top3": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, dimension, key ORDER BY t_end - t_begin DESC, t_begin, ref) AS r FROM shown) AS x WHERE r <= 3",
    "dd": """SELECT dataset_id, dimension, key, CAST(sum(t_end - t_begin) AS bigint) AS total, string_agg(ref, ',' ORDER BY r) AS samples, coalesce(any_value(refs), '') AS refs, greatest(0, min(t_begin) - 20) AS jump_begin, max(t_end) + 20 AS jump_end
  FROM top3 LEFT JOIN (SELECT dataset_id, dimension, key, string_agg(DISTINCT e, ',' ORDER BY e) AS refs FROM (SELECT dataset_id, dimension, key, unnest(ev) AS e FROM top3) AS y WHERE e IS NOT NULL GROUP BY ALL) AS z USING (dataset_id, dimension, key) GROUP BY dataset_id, dimension, key""",
    "rep": "SELECT dataset_id, count(*) AS event_count, min(ts) AS first_timestamp, max(core_id) AS cores FROM al GROUP BY dataset_id",
    "rep2": "SELECT dataset_id, event_count + CAST(dataset_id AS bigint) % 2 AS event_count, CASE WHEN CAST(dataset_id AS bigint) % 3 <> 0 THEN first_timestamp + CAST(dataset_id AS bigint) % 2 END AS first_timestamp, CASE WHEN dataset_id <> '1' THEN cores END AS cores FROM rep",
    "refs": "SELECT dataset_id, evidence AS ref FROM a5 UNION ALL SELECT dataset_id, evidence FROM alerts WHERE type = 'irq_pressure' UNION ALL SELECT dataset_id, slice_id FROM slices WHERE t_end > t_begin",
}
V["a5"] = METRIC_VIEWS["a5"].replace("ref, CASE", "ref AS evidence, CASE")
V["longrep"] = "SELECT dataset_id, field, value FROM (SELECT dataset_id, CAST(event_count AS varchar) AS event_count, CAST(first_timestamp AS varchar) AS first_timestamp, CAST(cores AS varchar) AS cores FROM rep) AS x UNPIVOT (value FOR field IN (event_count, first_timestamp, cores)) AS u"
V["longrep2"] = V["longrep"].replace("FROM rep)", "FROM rep2)")
CHAIN = """SELECT w.dataset_id, w.task_id, w.obj_id, coalesce(h.task_id, w.owner_task_id) AS owner_task_id, w.evidence_ref AS wait_evidence, h.evidence_ref AS hold_evidence, w.trusted AND coalesce(h.trusted, true) AS trusted
  FROM {w} AS w LEFT JOIN {h} AS h ON h.dataset_id = w.dataset_id AND h.obj_id = w.obj_id WHERE h.task_id IS NOT NULL OR w.owner_task_id IS NOT NULL"""
V["wh"] = f"SELECT * FROM holds JOIN scope USING (dataset_id) WHERE {OPEN}"
V["ww"] = f"SELECT * FROM waits JOIN scope USING (dataset_id) WHERE {OPEN}"
V["wc"] = CHAIN.format(w="ww", h="wh")



def page_sql(side: str, way: str, before: str, after: str) -> str:
    return f"""SELECT dataset_id, place, event_uid, ts, core_id, seq, trusted, has_more, total, {before} AS prev_cursor, {after} AS next_cursor FROM (
  SELECT dataset_id, CAST(row_number() OVER w AS int) AS place, event_uid, ts, core_id, seq, trusted, count(*) OVER (PARTITION BY dataset_id) > 50 AS has_more, count(*) OVER (PARTITION BY dataset_id) AS total, ts || ':' || core_id || ':' || seq AS name
  FROM al JOIN scope USING (dataset_id) WHERE (ts, core_id, seq) {side} (w_begin, 1, 0) WINDOW w AS (PARTITION BY dataset_id ORDER BY ts{way}, core_id{way}, seq{way})) AS x WHERE place <= 50
  WINDOW u AS (PARTITION BY dataset_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


SQL = {
    "b01_overlap_buckets": f"SELECT dataset_id, bucket, round(sum(part), 6) AS slices FROM ({parts('slices', 'whole', 32)}) AS p GROUP BY ALL",
    "b02_time_index": f"""SELECT dataset_id, bucket, core_id, round(sum(events), 6) AS events, round(sum(slices), 6) AS slices, round(sum(irqs), 6) AS irqs FROM (
  SELECT dataset_id, {bucket_of(128)} AS bucket, core_id, 1.0::double AS events, 0.0::double AS slices, 0.0::double AS irqs FROM al JOIN whole USING (dataset_id)
  UNION ALL SELECT dataset_id, bucket, core_id, 0.0, part, 0.0 FROM ({core_parts("slices")}) AS s UNION ALL SELECT dataset_id, bucket, core_id, 0.0, 0.0, part FROM ({core_parts("irqs")}) AS i) AS x GROUP BY ALL""",
    "b03_timeline_buckets": "SELECT dataset_id, bucket, round(coalesce(sum(x) FILTER (WHERE kind = 'events'), 0.0), 6) AS events, round(coalesce(sum(x) FILTER (WHERE kind = 'slices'), 0.0), 6) AS slices, round(coalesce(sum(x) FILTER (WHERE kind = 'irqs'), 0.0), 6) AS irqs FROM tb GROUP BY ALL",
    "b04_timeline_lod1": "SELECT dataset_id, 'slice' AS kind, slice_id AS id, t_begin, t_end FROM cs UNION ALL SELECT dataset_id, 'irq', irq_span_id, t_begin, t_end FROM ci UNION ALL SELECT dataset_id, 'switch', event_uid, ts, ts FROM ce WHERE event_name = 'CTX_SWITCH'",
    "b04_timeline_lod2": "SELECT * FROM (SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ts, core_id, seq) AS int) AS place, event_uid, event_name, ts FROM ce) AS x WHERE place <= 50",
    "b05_preview_buckets": f"SELECT dataset_id, bucket, count(*) AS events FROM (SELECT dataset_id, {bucket_of(24)} AS bucket FROM al JOIN whole USING (dataset_id)) AS x GROUP BY ALL",
    "b06_state_lanes": """SELECT dataset_id, task_id, 'task:' || task_id AS lane, string_agg(seg_id, ',' ORDER BY t_begin, t_end, seg_id) AS segments, min(t_begin) AS t_begin, max(t_end) AS t_end, bool_and(trusted) AS trusted,
  count(*) FILTER (WHERE state = 'READY') AS ready, count(*) FILTER (WHERE state = 'RUNNING') AS running, count(*) FILTER (WHERE state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE state = 'EXIT') AS exit FROM ct GROUP BY dataset_id, task_id""",
    "b06_state_lanes_core": """SELECT c.dataset_id, c.task_id, 'core:' || core_id AS lane, CAST(count(*) AS int) AS segments, min(t_begin) AS t_begin, max(t_end) AS t_end, bool_and(c.trusted) AS trusted,
  count(*) FILTER (WHERE state = 'READY') AS ready, count(*) FILTER (WHERE state = 'RUNNING') AS running, count(*) FILTER (WHERE state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE state = 'EXIT') AS exit FROM ct AS c JOIN al AS e ON e.event_uid = c.cause_event GROUP BY c.dataset_id, c.task_id, core_id""",
    "q01_event_page_forward": page_sql(">", "", "first_value(name) OVER u", "CASE WHEN has_more THEN last_value(name) OVER u END"),
    "q01_event_page_backward": page_sql("<", " DESC", "CASE WHEN has_more THEN last_value(name) OVER u END", "first_value(name) OVER u"),
    "q03_index_summary": "SELECT dataset_id, count(*) AS events, count(DISTINCT task_id) AS tasks, count(DISTINCT core_id) AS cores, count(DISTINCT event_name) AS kinds FROM al GROUP BY dataset_id",
    "q04_resource_graph": """SELECT dataset_id, coalesce(hold_edges, 0) AS hold_edges, coalesce(wait_edges, 0) AS wait_edges, coalesce(chains, 0) AS chains, coalesce(paths, 0) AS paths FROM scope
  LEFT JOIN (SELECT dataset_id, count(*) AS hold_edges FROM wh GROUP BY ALL) AS h USING (dataset_id) LEFT JOIN (SELECT dataset_id, count(*) AS wait_edges FROM ww GROUP BY ALL) AS w USING (dataset_id)
  LEFT JOIN (SELECT dataset_id, count(*) AS chains, count(DISTINCT CASE WHEN obj_id IS NOT NULL THEN (task_id, obj_id, owner_task_id) END) AS paths FROM wc GROUP BY ALL) AS c USING (dataset_id)""",
    "q04_graph_nodes": """SELECT *, CASE WHEN row_number() OVER w <= 5 THEN CAST(row_number() OVER w AS int) END AS rank FROM (SELECT dataset_id, node, count(*) FILTER (WHERE edge_kind = 'hold') AS holds, count(*) FILTER (WHERE edge_kind = 'wait') AS waits FROM (
  SELECT dataset_id, edge_kind, unnest(list_distinct(list_filter(['task:' || task_id, 'obj:' || obj_id, CASE WHEN owner_task_id IS DISTINCT FROM task_id THEN 'task:' || owner_task_id END], lambda x: x IS NOT NULL))) AS node FROM (SELECT * FROM wh UNION ALL SELECT * FROM ww) AS e) AS x GROUP BY dataset_id, node) AS y
  WINDOW w AS (PARTITION BY dataset_id ORDER BY holds + waits DESC, node)""",
    "q05_resource_drilldown": """SELECT dataset_id, obj_id, rank, seg_id, task_id, clipped, cause_event, cause_name, owner, CAST(coalesce(sum(least(t_end, s_end) - greatest(t_begin, s_begin)) FILTER (WHERE s_begin IS NOT NULL), 0) AS bigint) AS owner_ran, count(s_begin) AS owner_slices, greatest(0, t_begin - 20) AS jump_begin, t_end + 20 AS jump_end FROM (
  SELECT c.dataset_id, related_obj AS obj_id, CAST(row_number() OVER (PARTITION BY c.dataset_id, related_obj ORDER BY clipped DESC, t_begin, seg_id) AS int) AS rank, seg_id, c.task_id, clipped, t_begin, t_end, cause_event, e.event_name AS cause_name, e.owner_task_id AS owner FROM ct AS c LEFT JOIN al AS e ON e.event_uid = c.cause_event
    WHERE state = 'BLOCKED' AND related_obj IS NOT NULL) AS x LEFT JOIN (SELECT dataset_id AS d, task_id AS o, t_begin AS s_begin, t_end AS s_end FROM slices) AS s ON d = dataset_id AND o = owner AND s_begin < t_end AND t_begin < s_end WHERE rank <= 3 GROUP BY ALL""",
    "q05_drilldown_events": """SELECT dataset_id, obj_id, CAST(place AS int) AS place, event_uid, event_name, task_id, greatest(0, ts - 20) AS jump_begin, ts + 20 AS jump_end FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, obj_id ORDER BY ts, core_id, seq) AS place FROM ce
  WHERE event_name IN ('SYNC_LOCK', 'SYNC_UNLOCK', 'SYNC_TRY', 'TASK_BLOCK', 'TASK_WAKEUP') AND obj_id IS NOT NULL) AS x WHERE place <= 10""",
    "q06_alerts_query": "SELECT alert_id, type FROM alerts WHERE task_id = 2",
    "q09_metric_evidence": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY value DESC, ref) AS int) AS rank FROM (
  SELECT dataset_id, 'cpu_utilization' AS metric_id, slice_id AS ref, clipped AS value FROM cs UNION ALL SELECT dataset_id, 'blocked_time', seg_id, clipped FROM ct WHERE state = 'BLOCKED' UNION ALL SELECT dataset_id, 'ready_wait_time', seg_id, clipped FROM ct WHERE state = 'READY'
  UNION ALL SELECT dataset_id, 'response_time', seg_id, response FROM samples UNION ALL SELECT dataset_id, 'irq_busy_time', irq_span_id, clipped FROM ci
  UNION ALL SELECT dataset_id, 'irq_latency', irq_span_id, clipped FROM ci WHERE delayed_task IS NOT NULL UNION ALL SELECT dataset_id, 'context_switch_count', event_uid, -ts FROM ce WHERE event_name = 'CTX_SWITCH'
  UNION ALL SELECT s.dataset_id, 'response_jitter', seg_id, response FROM samples AS s SEMI JOIN widest AS j ON j.dataset_id = s.dataset_id AND j.task_id = s.task_id) AS x) AS y WHERE rank <= 3""",
    "j01_cause_event_join": "SELECT seg_id, event_name, core_id FROM states AS s LEFT JOIN al AS e ON e.event_uid = s.cause_event",
    "j02_wait_chains": CHAIN.format(w="waits", h="holds"),
    "j03_preempting_slices": """SELECT b.seg_id, s.slice_id, s.task_id AS m_task FROM ct AS b JOIN al AS c ON c.event_uid = b.cause_event JOIN prios AS p ON p.dataset_id = b.dataset_id AND p.task_id = b.task_id
  JOIN prios AS o ON o.dataset_id = b.dataset_id AND o.task_id = c.owner_task_id JOIN cs AS s ON s.dataset_id = b.dataset_id AND s.t_begin < b.t_end AND b.t_begin < s.t_end JOIN prios AS q ON q.dataset_id = s.dataset_id AND q.task_id = s.task_id
  WHERE b.state = 'BLOCKED' AND b.related_obj IS NOT NULL AND p.prio < q.prio AND q.prio < o.prio AND s.task_id NOT IN (b.task_id, c.owner_task_id)""",
    "j09_last_priority_asof": "SELECT * FROM prios",
    "j10_nearest_event": """SELECT dataset_id, CAST(at_ts AS varchar) AS probe, (SELECT arg_min(event_uid, (abs(e.ts - p.at_ts), e.ts, e.core_id, e.seq)) FROM al AS e WHERE e.dataset_id = p.dataset_id) AS event_uid
  FROM (SELECT dataset_id, unnest(range(w_begin, w_end + 1, greatest((w_end - w_begin) // 20, 1))) AS at_ts FROM scope) AS p""",
    "j13_evidence_resolution": """SELECT DISTINCT r.dataset_id, ref, m.uid AS event_uid FROM refs AS r JOIN (SELECT event_uid AS k, event_uid AS uid FROM al UNION ALL SELECT slice_id, start_event FROM slices UNION ALL SELECT slice_id, end_event FROM slices WHERE end_event IS NOT NULL) AS m ON m.k = r.ref""",
    "p01_metric": outer_sql("mv", ["metric_id"], ["value"], ", CASE WHEN b_value <> 0 THEN round(c_value / b_value, 6) END AS ratio, CASE WHEN d_value > 0 THEN 'up' WHEN d_value < 0 THEN 'down' ELSE 'flat' END AS trend, (SELECT any_value(codes) FROM codes AS k WHERE k.pair = o.pair AND k.side = 0) AS b_reason_codes, (SELECT any_value(codes) FROM codes AS k WHERE k.pair = o.pair AND k.side = 1) AS c_reason_codes"),
    "p02_alert": outer_sql("an", ["type", "severity"], ["n"], ", greatest(d_n, 0) AS added, greatest(-d_n, 0) AS removed"),
    "p03_hotspot": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pair ORDER BY abs(d_n) DESC, greatest(b_n, c_n) DESC, node) AS int) AS rank FROM ({outer_sql('nodes', ['node'], ['n'])}) AS z SEMI JOIN hot USING (pair, node)) AS y WHERE rank <= 5",
    "p04_interval": outer_sql("lb", [], ["longest"]),
    "p05_task": f"SELECT *, CAST(row_number() OVER (PARTITION BY pair ORDER BY abs(d_blocked) DESC, greatest(b_blocked, c_blocked) DESC, task_id) AS int) AS rank FROM ({outer_sql('tt', ['task_id'], ['runtime', 'blocked'])}) AS z",
    "p06_core": outer_sql("cc", ["core_id"], ["runtime", "switches"]),
    "p07_resource": outer_sql("rr", ["obj_id"], ["events", "blocked"]),
    "p08_irq": outer_sql("ii", ["irq_id"], ["busy", "spans"]),
    "p09_diff_detail": """SELECT pair, dimension, key, b_total, b_samples, b_refs, b_jump_begin, b_jump_end, c_total, c_samples, c_refs, c_jump_begin, c_jump_end FROM
  (SELECT CAST(dataset_id AS bigint) // 2 AS pair, dimension, key, total AS b_total, samples AS b_samples, refs AS b_refs, jump_begin AS b_jump_begin, jump_end AS b_jump_end FROM dd WHERE CAST(dataset_id AS bigint) % 2 = 0) AS b FULL JOIN
  (SELECT CAST(dataset_id AS bigint) // 2 AS pair, dimension, key, total AS c_total, samples AS c_samples, refs AS c_refs, jump_begin AS c_jump_begin, jump_end AS c_jump_end FROM dd WHERE CAST(dataset_id AS bigint) % 2 = 1) AS c USING (pair, dimension, key)""",
    "p11_summary_drift": """SELECT dataset_id, field, e.value AS expected, a.value AS actual, CASE WHEN e.value IS NULL THEN 'UNEXPECTED_ACTUAL_FIELD' WHEN a.value IS NULL THEN 'MISSING_ACTUAL_FIELD' WHEN field LIKE '%count' THEN 'COUNT_MISMATCH' WHEN field LIKE '%timestamp' THEN 'TIMESTAMP_MISMATCH' ELSE 'VALUE_MISMATCH' END AS mismatch
  FROM longrep AS e FULL JOIN longrep2 AS a USING (dataset_id, field) WHERE e.value IS DISTINCT FROM a.value""",
    "p12_fact_drift": """SELECT dataset_id, unnest(list_filter([CASE WHEN r.event_count IS DISTINCT FROM q.event_count THEN 'event_count' END, CASE WHEN r.first_timestamp IS DISTINCT FROM q.first_timestamp THEN 'first_timestamp' END,
  CASE WHEN r.cores IS DISTINCT FROM q.cores THEN 'cores' END], lambda x: x IS NOT NULL)) AS drifted FROM rep AS r JOIN rep2 AS q USING (dataset_id)""",
    "p13_replay_invariants": "SELECT dataset_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, count(*) FILTER (WHERE ts < before) AS regressions FROM (SELECT *, lag(ts) OVER (PARTITION BY dataset_id, core_id ORDER BY seq) AS before FROM al) AS x GROUP BY dataset_id",
}
#: Queries that read some interval tables more than once.
REREAD = {"p01_metric", "p02_alert", "p09_diff_detail", "q06_alerts_query", "q09_metric_evidence", "j13_evidence_resolution"}
QUERIES = {k: over_trace(f, keep=k in REREAD) for k, f in TRACE.items()}
ORACLE = {k: with_views(v, V) for k, v in SQL.items()}
