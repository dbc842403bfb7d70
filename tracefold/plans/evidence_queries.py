"""Registered queries: lineage, provenance, closures, completeness and exports."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle, shared_dir
from ..operators import alerts as al
from ..operators import completeness as cm
from ..operators import evidence as ev
from ..operators import export as ex
from ..operators import lineage as ln
from ..operators.filters import in_window
from ..operators import align, integrity, rebuild
from ..operators.metrics import metric_values
from .metric_queries import SQL as METRIC_SQL, TH, V as METRIC_VIEWS
from .sql import CRC32, VIEWS, with_views
from .trace import TraceTables, over_trace


def _alerts(t):
    return t.alerts(TH)


def _marks(t, alerts):
    """Clock calibrations as anchors, and priority inversions as the context of an analysis."""
    anchors = t.events.where("event_name in ('SYNC_CALIB', 'TS_CALIB')").select("dataset_id", F.lit("anchor").alias("family"), F.concat(F.lit("anchor:"), "event_uid").alias("mark"), F.col("event_uid").alias("ref"))
    contexts = alerts.where("type = 'priority_inversion'").select("dataset_id", F.lit("context").alias("family"), F.concat(F.lit("context:"), "dataset_id").alias("mark"), F.col("evidence").alias("ref"))
    return anchors.unionByName(contexts)


def _edges(t):
    alerts = _alerts(t)
    return ev.dependency_edges(t, alerts, _marks(t, alerts))


def _seeds(t):
    """All six kinds of starts, against events of which some are gone."""
    alerts = _alerts(t)
    spans = t.scope.select("dataset_id", F.concat(F.lit("span:"), "dataset_id").alias("span"), "w_begin", F.expr("w_begin + (w_end - w_begin) div 20").alias("w_end"))
    manual = t.events.where("seq % 100 = 1").select("dataset_id", F.col("event_uid").alias("ref"))
    return ev.seeds(alerts, t.events.where("seq % 3 <> 0"), None, _marks(t, alerts), manual, spans)


def _closure(t):
    alerts = _alerts(t)
    starts = ev.seeds(alerts, t.events).where("found and kind = 'alert'").select("dataset_id", "closure_id", "ref")
    # one event in 200 can't be read
    return ev.closure(settle(ev.dependency_edges(t, alerts, _marks(t, alerts))), starts, ev.Budget(), events=t.events.where("seq % 200 <> 0"), frontier_limit=8)


def clipped_trace(t: TraceTables) -> TraceTables:
    """The tables rebuilt from the events of the scope alone."""
    c = TraceTables(t.raw, keep=True, long=t.is_long)
    c.__dict__["events"] = settle(in_window(t.events, t.scope).drop("w_begin", "w_end"))
    # every third clip states a scope that ends too early
    c.__dict__["scope"] = t.scope.withColumn("w_end", F.col("w_end") - F.when(F.col("dataset_id").cast("long") % 3 == 1, 1).otherwise(0))
    # damage of the input is what the full trace knows of it
    parts = [integrity.loss_overflow_windows(t.raw), align.degraded_windows(t.events), rebuild.relation_windows(c.holds, c.waits, c.irqs)]
    c.__dict__["windows"] = reduce(DataFrame.unionByName, parts, integrity.seq_gap_windows(t.raw))
    return c


def _both(t, table, key, fields, clip: TraceTables | None = None):
    return cm.compare_by_key(table(t), table(clip or clipped_trace(t)), ["dataset_id", *key], fields)


COMPARED = {
    "scope": (lambda t: t.scope, [], ["w_begin", "w_end"]),
    "alerts": (lambda t: t.alerts(TH), ["alert_id"], ["t_begin", "t_end", "task_id", "actual", "support_level"]),
    "diagnoses": (lambda t: al.diagnose(t.alerts(TH)), ["diag_id"], ["title", "conclusion", "confidence"]),
    "metrics": (lambda t: metric_values(t, t.scope), ["metric_id"], ["value"]),
    "resources": (lambda t: cm.resource_totals(t, t.scope), ["kind", "id"], ["first", "second"]),
}


def _all_findings(t):
    """Findings of everything that is compared."""
    clip = clipped_trace(t)
    return reduce(DataFrame.unionByName, [_both(t, *c, clip).select("dataset_id", "finding", F.lit(n).alias("what")) for n, c in COMPARED.items()])


def _marked_clip(t):
    """The clipped package with its alerts, diagnoses and marks."""
    alerts = _alerts(t)
    marks = _marks(t, alerts)
    return ex.clip(t, t.scope) | {"alerts": alerts, "diagnoses": al.diagnose(alerts), "anchors": marks.where("family = 'anchor'"), "contexts": marks.where("family = 'context'")}


def _planted_lineage(t):
    """Records against events of which some are gone, lists that lack some windows and name two that don't belong, and objects of which some differ, are gone or are new."""
    rec = settle(ln.records(t))
    code = F.pmod(F.crc32(F.encode("object_id", "utf-8")), F.lit(50))
    touching = settle(ln.touching_windows(rec, t.windows))
    named = touching.where(code != 1).select("dataset_id", "object_id", "window_ids")
    extra = F.when(code == 7, F.array(F.lit("uw:nowhere"), F.concat(F.lit("uw:far:"), "dataset_id")))
    none = F.array().cast("array<string>")
    listed = rec.select("dataset_id", "object_id").join(named, ["dataset_id", "object_id"], "left").withColumn("window_ids", F.concat(F.coalesce("window_ids", none), F.coalesce(extra, none)))
    far = rec.select("dataset_id").distinct().select("dataset_id", F.concat(F.lit("uw:far:"), "dataset_id").alias("window_id"), F.lit(-9).cast("long").alias("t_begin"), F.lit(-8).cast("long").alias("t_end"))
    windows = t.windows.select("dataset_id", "window_id", "t_begin", "t_end").unionByName(far)
    objects = rec.where(code != 3).select("dataset_id", "object_id", "t_begin", (F.col("t_end") + F.when(code == 5, 1).otherwise(0)).alias("t_end")).unionByName(rec.where(code == 9).select("dataset_id", F.concat("object_id", F.lit(":new")).alias("object_id"), "t_begin", "t_end"))
    opened = rec.withColumn("open_event", F.when(code == 11, F.concat("open_event", F.lit("x"))).otherwise(F.col("open_event")))
    return ln.violations(opened, t.events.where("seq % 40 <> 0"), windows, listed, objects, touching)


def _lacking(t):
    """Kinds of objects for which a trace has no events (odd traces are taken to lack locks)."""
    return t.events.select("dataset_id").distinct().where("cast(dataset_id as bigint) % 2 = 1").withColumn("object_type", F.lit("hold"))


def _proofs(t):
    """Proofs stated for another budget depth in some closures, checked again."""
    closures = settle(_closure(t)[1])
    stated = ev.proof_digest(closures.withColumn("refs", F.when(F.crc32(F.encode("closure_id", "utf-8")) % 4 == 0, F.col("refs") + 1).otherwise(F.col("refs"))))
    return ev.proof_check(stated, closures).groupBy("dataset_id", "status").agg(F.count("*").alias("n"))


def _validity_rows(t):
    one = lambda df, ident: df.select("dataset_id", F.col(ident).alias("object_id"), F.when(F.col("trusted"), "exact").otherwise("bounded").alias("scope"), F.lit("rebuilt").alias("derivation"))
    return one(t.states, "cause_event").unionByName(one(t.slices, "start_event")).unionByName(one(t.holds, "evidence_ref"))


def _consumer(t):
    closed, closures = _closure(t)
    v = closed.withColumnRenamed("ref", "object_id").join(ev.validity_index(_validity_rows(t)), ["dataset_id", "object_id"])
    v = v.groupBy("dataset_id", "closure_id").agg(F.count_if("conflict").alias("conflicts"), F.count_if(F.col("least_scope") == "bounded").alias("untrusted"))
    return ev.consumer_mode(closures, v)


def _plan(t):
    """Reads for the events of interrupts: exits are hinted by their spans, enters stand in an index that lacks one event in 50, and one ref is nowhere."""
    none = F.lit(None).cast("long")
    hints = t.irqs.where("exit_event is not null").select("dataset_id", "core_id", F.col("exit_event").alias("ref"), F.col("t_begin").alias("begin"), F.col("t_end").alias("end"), none.alias("seq_begin"), none.alias("seq_end"))
    refs = t.irqs.select("dataset_id", F.explode(F.array_compact(F.array("enter_event", "exit_event"))).alias("ref")).unionByName(t.scope.select("dataset_id", F.concat(F.lit("evt:"), "dataset_id", F.lit(":gone")).alias("ref")))
    return ev.window_plan(hints, ["dataset_id", "core_id"], refs, ex.ref_index(t.events).where("seq % 50 <> 0"), 3_600_000_000)


def _plan_stats(t):
    spans, planned, unplanned = _plan(t)
    return ev.read_plan_stats(settle(spans), planned, unplanned, t.events.where("seq % 40 <> 0"), ["dataset_id", "core_id"])


def _families(t):
    return ev.closure_families(_closure(t)[0], t.events.where("seq % 200 <> 0"))


def _damaged_package(t):
    """A package read back without one event in 60."""
    package = _exported(t)
    return package | {"events": package["events"].where("seq % 60 <> 0")}


def _exported(t):
    path = f"{shared_dir(t.raw.sparkSession)}/package-{uuid.uuid4().hex}"
    alerts = _alerts(t)
    more = {"alerts": alerts, "diagnoses": al.diagnose(alerts), "metrics": metric_values(t, t.scope), "anchors": _marks(t, alerts).where("family = 'anchor'")}
    ex.export_full(t, path, more)
    return ex.scan_package(t.raw.sparkSession, path, tuple(more))


TRACE = {
    "l01_lineage_records": lambda t: ln.records(t).withColumn("sources", F.array_join(F.array_sort("sources"), ",")),
    "l02_lineage_windows": lambda t: ln.touching_windows(ln.records(t), t.windows).withColumns({"window_ids": F.array_join("window_ids", ","), "reasons": F.array_join("reasons", ",")}),
    "l03_lineage_status": lambda t: ln.status(settle(ln.records(t)), t.windows, ln.reused_ids(t.events), _lacking(t)),
    "l04_lineage_backtrace": lambda t: ln.backtrace(ln.records(t), t.events),
    "l05_reused_ids": lambda t: ln.reused_ids(t.events.unionByName(t.events.where("seq % 50 = 0").withColumn("ts", F.col("ts") + 1))),
    "l06_lineage_subset": lambda t: ln.subset(ln.records(t), t.slices.where("not trusted").select("dataset_id", F.col("slice_id").alias("object_id"))).select("object_id", "open_event", "close_event"),
    "l07_lineage_validate": _planted_lineage,
    "e01_dependency_edges": _edges,
    "e02_edge_contract": lambda t: ev.contract_rejects(_edges(t).withColumn("time_hint", F.when(F.col("seq_hint") % 10 == 0, 0).otherwise(F.col("time_hint")))),
    "e03_seed_resolution": _seeds,
    "e04_closure": lambda t: _closure(t)[1],
    "e04_closure_families": _families,
    "e05_proof_digest": lambda t: ev.proof_digest(_closure(t)[1]),
    "e05_proof_check": _proofs,
    "e06_window_plan": lambda t: _plan(t)[0],
    "e06_unplanned_refs": lambda t: _plan(t)[2],
    "e07_read_plan_stats": _plan_stats,
    "e08_edge_partitions": lambda t: ev.edge_partitions(_edges(t)),
    "e09_validity_index": lambda t: ev.validity_index(_validity_rows(t)),
    "e10_consumer_mode": _consumer,
    "v01_verdict": lambda t: cm.verdict(_all_findings(t), t.scope),
    "v01_scope_identity": lambda t: _both(t, *COMPARED["scope"]),
    "v02_alert_completeness": lambda t: _both(t, *COMPARED["alerts"]),
    "v03_diagnosis_completeness": lambda t: _both(t, *COMPARED["diagnoses"]),
    "v04_metric_completeness": lambda t: _both(t, *COMPARED["metrics"]),
    "v05_resource_semantics": lambda t: _both(t, *COMPARED["resources"]),
    "v06_lost_edges": lambda t: cm.lost_edges(in_window(t.holds.unionByName(t.waits), t.scope), (c := clipped_trace(t)).holds.unionByName(c.waits)),
    "v07_ref_closure": lambda t: ex.missing_refs(_marked_clip(t), by_category=True),
    "v08_validity_coverage": lambda t: _both(t, lambda x: ev.validity_index(_validity_rows(x)), ["object_id"], ["least_scope", "rows", "conflict"]),
    "k06_metric_export": lambda t: ex.metric_rows(metric_values(t, t.scope)),
    "k01_export_full": lambda t: ex.manifest(_exported(t)),
    "k02_export_clipped": lambda t: ex.manifest(ex.clip(t, t.scope)),
    "k02_export_filtered": lambda t: ex.manifest(ex.clip(t, t.scope, {"task_id": 3})),
    "s10_scan_package": lambda t: _exported(t)["slices"].select("dataset_id", "slice_id", "t_begin", "t_end"),
    "q07_package_ref_check": lambda t: ex.missing_refs(_damaged_package(t), by_category=True),
    "k04_ref_index": lambda t: ex.ref_index(t.events),
    "k05_required_refs": lambda t: ex.required_refs({n: getattr(t, n) for n in ("states", "slices", "holds", "waits", "irqs")}),
    "k08_merge_segments": lambda t: ex.merge_segments([t.raw.where(F.col("seq") <= 100), t.raw.where(F.col("seq") > 100)]).select("event_uid", "ts_raw"),
    "k09_scale_up": lambda t: ex.scale_up(t.raw, 3).select("dataset_id", "core_id", "seq", "ts_raw", "copy"),
    "k10_perturb_variant": lambda t: ex.perturb(t.raw).select("event_uid", "ts_raw", "reason", "prio"),
}

#: Views before the rebuild, which a clipped trace shares with the full one.
SHARED = {"named", "payload", "ev", "prev", "tagged", "cores", "cal", "al", "gap_windows", "loss_windows", "align_windows"}
NAMES = (set(VIEWS) | set(METRIC_VIEWS)) - SHARED


def clipped(text: str) -> str:
    """The view's SQL over the clipped trace: names of rebuilt views get the prefix c_, aligned events are those of the scope."""
    return re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} c_{m[2]}" if m[2] in NAMES | {"al", "resources", "diags", "mv", "valid", "valid_rows"} else m[0], text)


REC = """SELECT dataset_id, slice_id AS object_id, 'exec_slice' AS object_type, start_event AS open_event, end_event AS close_event, [dispatch_event, start_event, end_event] AS s, t_begin, t_end, NULL AS reason_code FROM slices
  UNION ALL SELECT dataset_id, seg_id, 'task_state', cause_event, cause_event, [cause_event], t_begin, t_end, NULL FROM states
  UNION ALL SELECT dataset_id, edge_kind || ':' || dataset_id || ':' || evidence_ref || ':' || coalesce(CAST(obj_id AS varchar), '-'), edge_kind, CASE WHEN close_kind <> 'UNMATCHED' THEN evidence_ref END, CASE WHEN close_kind = 'UNMATCHED' THEN evidence_ref ELSE end_event END,
    [evidence_ref, end_event], t_begin, t_end, reason_code FROM both_edges
  UNION ALL SELECT dataset_id, irq_span_id, 'irq_span', enter_event, exit_event, [enter_event, exit_event], t_begin, t_end, CASE close_kind WHEN 'UNMATCHED' THEN 'IRQ_EXIT_WITHOUT_MATCHING_ENTER' WHEN 'OPEN' THEN 'IRQ_ENTER_WITHOUT_EXIT' END FROM irqs"""
V = {
    **METRIC_VIEWS,
    "both_edges": "SELECT * FROM holds UNION ALL SELECT * FROM waits",
    "rec0": REC,
    "rec": "SELECT dataset_id, object_id, object_type, 'rebuild.' || object_type AS rule_id, open_event, close_event, list_sort(list_distinct(list_filter(s, lambda x: x IS NOT NULL))) AS sources, t_begin, t_end, reason_code FROM rec0",
    "coded": f"SELECT *, {CRC32.format('object_id')} % 50 AS code FROM rec",
    "src": "SELECT dataset_id, object_id, unnest(sources) AS event_uid FROM rec",
    "touch": """SELECT r.dataset_id, r.object_id, string_agg(window_id, ',' ORDER BY w.t_begin, w.t_end, window_id) AS window_ids, string_agg(DISTINCT w.reason_code, ',' ORDER BY w.reason_code) AS reasons, count(*) AS n
  FROM rec AS r JOIN windows AS w ON w.dataset_id = r.dataset_id AND w.t_begin <= r.t_end AND r.t_begin <= w.t_end GROUP BY ALL""",
    "marks": """SELECT dataset_id, 'anchor' AS family, 'anchor:' || event_uid AS mark, event_uid AS ref FROM al WHERE event_name IN ('SYNC_CALIB', 'TS_CALIB') UNION ALL SELECT dataset_id, 'context', 'context:' || dataset_id, evidence FROM alerts WHERE type = 'priority_inversion'""",
    "starts": """SELECT dataset_id, 'alert' AS kind, alert_id AS closure_id, evidence AS ref FROM alerts WHERE evidence IS NOT NULL UNION ALL SELECT dataset_id, 'diagnosis', 'diag:' || alert_id, evidence FROM alerts WHERE evidence IS NOT NULL
  UNION ALL SELECT dataset_id, family, mark, ref FROM marks UNION ALL SELECT dataset_id, 'manual', 'manual:' || event_uid, event_uid FROM al WHERE seq % 100 = 1
  UNION ALL SELECT dataset_id, 'span', 'span:' || dataset_id, event_uid FROM al JOIN scope USING (dataset_id) WHERE seq % 3 <> 0 AND ts BETWEEN w_begin AND w_begin + (w_end - w_begin) // 20""",
    "diags": METRIC_SQL["x08_diagnose"],
    "mv": METRIC_SQL["m12_metric_value"],
    "resources": """SELECT dataset_id, kind, id, CAST(sum(first) AS bigint) AS first, CAST(sum(second) AS bigint) AS second FROM (SELECT dataset_id, 'task' AS kind, task_id AS id, clipped AS first, 0 AS second FROM cs UNION ALL SELECT dataset_id, 'task', task_id, 0, clipped FROM ct WHERE state = 'BLOCKED'
  UNION ALL SELECT dataset_id, 'core', core_id, clipped, 0 FROM cs UNION ALL SELECT dataset_id, 'core', core_id, 0, 1 FROM ce WHERE event_name = 'CTX_SWITCH' UNION ALL SELECT dataset_id, 'object', obj_id, 1, 0 FROM ce WHERE obj_id IS NOT NULL
  UNION ALL SELECT dataset_id, 'object', related_obj, 0, clipped FROM ct WHERE state = 'BLOCKED' AND related_obj IS NOT NULL) AS x GROUP BY ALL""",
    "mentioned": """SELECT dataset_id, 'states' AS category, cause_event AS ref_key FROM ct UNION SELECT dataset_id, 'slices', start_event FROM cs UNION SELECT dataset_id, 'slices', end_event FROM cs UNION SELECT dataset_id, edge_kind || 's', evidence_ref FROM kept_edges
  UNION SELECT dataset_id, edge_kind || 's', end_event FROM kept_edges UNION SELECT dataset_id, 'irqs', enter_event FROM ci UNION SELECT dataset_id, 'irqs', exit_event FROM ci UNION SELECT dataset_id, 'alerts', evidence FROM alerts UNION SELECT dataset_id, 'diagnoses', evidence FROM alerts
  UNION SELECT dataset_id, family || 's', ref FROM marks""",
    "pairs": """SELECT dataset_id, event_uid AS a, lead(event_uid) OVER (PARTITION BY dataset_id ORDER BY ts, core_id, seq) AS b, 50 AS p, 45 AS q, 'ref_ref' AS r, 'order' AS f FROM al
  UNION ALL SELECT dataset_id, slice_id, start_event, 80, 80, 'slice_start', 'slice' FROM slices UNION ALL SELECT dataset_id, slice_id, end_event, 80, 80, 'slice_end', 'slice' FROM slices
  UNION ALL SELECT dataset_id, seg_id, cause_event, 85, 85, 'state_cause', 'state' FROM states UNION ALL SELECT dataset_id, edge_kind || ':' || evidence_ref, evidence_ref, 90, 90, 'edge_evidence', 'resource' FROM both_edges
  UNION ALL SELECT dataset_id, alert_id, evidence, 100, 100, 'alert_evidence', 'alert' FROM alerts UNION ALL SELECT dataset_id, 'diag:' || alert_id, alert_id, 95, 95, 'diagnosis_alert', 'diagnosis' FROM alerts
  UNION ALL SELECT dataset_id, mark, ref, 92, 92, family || '_ref', family FROM marks""",
    "ends2": "SELECT dataset_id, src_ref, dst_ref, relation_kind, rule_family, max(priority) AS priority FROM (SELECT dataset_id, a AS src_ref, b AS dst_ref, p AS priority, r AS relation_kind, f AS rule_family FROM pairs UNION ALL SELECT dataset_id, b, a, q, r, f FROM pairs) AS x WHERE src_ref <> dst_ref AND src_ref IS NOT NULL AND dst_ref IS NOT NULL GROUP BY ALL",
    "edges": """SELECT e.dataset_id, src_ref, dst_ref, relation_kind, rule_family, priority, coalesce(d.ts, s.ts, 0) AS time_hint, coalesce(d.core_id, s.core_id) AS core_hint, coalesce(d.seq, s.seq) AS seq_hint,
  least(src_ref, dst_ref) || '|' || greatest(src_ref, dst_ref) AS cycle_token, 1 AS estimate_events, 64 AS estimate_bytes, sha256('s0|' || rule_family || '|' || relation_kind || '|' || src_ref || '|' || dst_ref) AS edge_hash
  FROM ends2 AS e LEFT JOIN al AS d ON d.event_uid = e.dst_ref LEFT JOIN al AS s ON s.event_uid = e.src_ref""",
    "valid_rows": """SELECT dataset_id, cause_event AS object_id, CASE WHEN trusted THEN 'exact' ELSE 'bounded' END AS scope, 'rebuilt' AS derivation FROM states UNION ALL SELECT dataset_id, start_event, CASE WHEN trusted THEN 'exact' ELSE 'bounded' END, 'rebuilt' FROM slices
  UNION ALL SELECT dataset_id, evidence_ref, CASE WHEN trusted THEN 'exact' ELSE 'bounded' END, 'rebuilt' FROM holds""",
    "want": "SELECT dataset_id, enter_event AS ref FROM irqs WHERE enter_event IS NOT NULL UNION SELECT dataset_id, exit_event FROM irqs WHERE exit_event IS NOT NULL UNION SELECT dataset_id, 'evt:' || dataset_id || ':gone' FROM scope",
    "hinted": """SELECT dataset_id, core_id, exit_event AS ref, t_begin AS b, t_end AS e, CAST(NULL AS bigint) AS sb, CAST(NULL AS bigint) AS se, 1 AS edges FROM irqs WHERE exit_event IS NOT NULL
  UNION ALL SELECT a.dataset_id, core_id, ref, ts, ts, seq, seq, 0 FROM al AS a JOIN want ON want.dataset_id = a.dataset_id AND ref = event_uid WHERE seq % 50 <> 0 AND event_uid NOT IN (SELECT exit_event FROM irqs WHERE exit_event IS NOT NULL)""",
    "gaps": "SELECT dataset_id, least(greatest(CAST(floor(quantile_cont(e - b, 0.5)) AS bigint), 0), 3600000000) AS gap FROM hinted GROUP BY dataset_id",
    "reached": "SELECT *, max(e) OVER (PARTITION BY dataset_id, core_id ORDER BY b, e, ref, edges ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hinted JOIN gaps USING (dataset_id)",
    "islands": "SELECT *, CAST(sum(CASE WHEN reach IS NULL OR b > reach + gap THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, core_id ORDER BY b, e, ref, edges ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM reached",
    "plan": "SELECT dataset_id, core_id, island, min(b) AS t_begin, max(e) AS t_end, CASE WHEN count(sb) = count(*) THEN min(sb) END AS seq_begin, CASE WHEN count(se) = count(*) THEN max(se) END AS seq_end, CAST(sum(edges) AS bigint) AS edges, count(DISTINCT ref) AS refs FROM islands GROUP BY ALL",
    "hits": """SELECT DISTINCT i.dataset_id, i.ref FROM islands AS i JOIN plan AS p ON p.dataset_id = i.dataset_id AND p.core_id = i.core_id AND p.island = i.island JOIN al AS a ON a.event_uid = i.ref AND a.core_id = i.core_id
  WHERE a.seq % 40 <> 0 AND a.ts BETWEEN p.t_begin AND p.t_end AND (p.seq_begin IS NULL OR a.seq >= p.seq_begin) AND (p.seq_end IS NULL OR a.seq <= p.seq_end)""",
    "every_mention": """SELECT dataset_id, 'states' AS category, cause_event AS ref_key FROM states UNION SELECT dataset_id, 'slices', start_event FROM slices UNION SELECT dataset_id, 'slices', end_event FROM slices UNION SELECT dataset_id, edge_kind || 's', evidence_ref FROM both_edges
  UNION SELECT dataset_id, edge_kind || 's', end_event FROM both_edges UNION SELECT dataset_id, 'irqs', enter_event FROM irqs UNION SELECT dataset_id, 'irqs', exit_event FROM irqs UNION SELECT dataset_id, 'alerts', evidence FROM alerts UNION SELECT dataset_id, 'diagnoses', evidence FROM alerts
  UNION SELECT dataset_id, 'anchors', ref FROM marks WHERE family = 'anchor'""",
    "filtered_windows": """SELECT dataset_id, window_id FROM cw UNION SELECT w.dataset_id, w.window_id FROM windows AS w JOIN (SELECT * FROM kept_edges WHERE task_id = 3 OR owner_task_id = 3) AS k ON k.dataset_id = w.dataset_id AND w.window_id = 'uw:' || k.dataset_id || ':' || k.reason_code || ':' || k.evidence_ref""",
    "mentions": "SELECT dataset_id, cause_event AS ref_key FROM states UNION SELECT dataset_id, start_event FROM slices UNION SELECT dataset_id, end_event FROM slices UNION SELECT dataset_id, evidence_ref FROM both_edges UNION SELECT dataset_id, end_event FROM both_edges UNION SELECT dataset_id, enter_event FROM irqs UNION SELECT dataset_id, exit_event FROM irqs",
    "c_al": "SELECT al.* FROM al JOIN scope USING (dataset_id) WHERE ts BETWEEN w_begin AND w_end",
    "kept_edges": "SELECT e.* FROM both_edges AS e JOIN scope USING (dataset_id) WHERE t_begin < w_end AND t_end > w_begin",
    "kept_windows": """SELECT dataset_id, window_id FROM cw UNION SELECT w.dataset_id, w.window_id FROM windows AS w JOIN kept_edges AS k ON k.dataset_id = w.dataset_id AND w.window_id = 'uw:' || k.dataset_id || ':' || k.reason_code || ':' || k.evidence_ref""",
}
V["valid"] = "SELECT dataset_id, object_id, count(*) AS rows, min(scope) AS least_scope, count(DISTINCT (scope, derivation)) > 1 AS conflict FROM valid_rows GROUP BY dataset_id, object_id"
V |= {f"c_{n}": clipped((VIEWS | METRIC_VIEWS)[n]) for n in NAMES} | {f"c_{n}": clipped(V[n]) for n in ("diags", "mv", "resources", "valid", "valid_rows")}
V["c_both_edges"] = "SELECT * FROM c_holds UNION ALL SELECT * FROM c_waits"
V["c_scope"] = "SELECT dataset_id, w_begin, w_end - CASE WHEN CAST(dataset_id AS bigint) % 3 = 1 THEN 1 ELSE 0 END AS w_end FROM scope"


def findings(full: str, clip: str, key: list[str], fields: list[str], numbers: list[str] | None = None) -> str:
    using = ", ".join(key)
    diff = ", ".join(f"CASE WHEN f.{x} IS DISTINCT FROM c.{x} THEN '{x}' END" for x in fields)
    delta = f"round(greatest({', '.join(f'CAST(abs(f.{x} - c.{x}) AS double)' for x in numbers)}, 0.0::double), 6)" if numbers else "0.0::double"
    return f"""SELECT * FROM (SELECT {using}, CASE WHEN c.{fields[0]} IS NULL THEN 'missing' WHEN f.{fields[0]} IS NULL THEN 'extra' ELSE 'different' END AS finding, {delta} AS delta,
  CASE WHEN f.{fields[0]} IS NOT NULL AND c.{fields[0]} IS NOT NULL THEN array_to_string(list_filter([{diff}], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields FROM {full} AS f FULL JOIN {clip} AS c USING ({using})) AS x WHERE finding <> 'different' OR fields <> ''"""


FOUND = {
    "scope": findings("scope", "c_scope", ["dataset_id"], ["w_begin", "w_end"], ["w_begin", "w_end"]),
    "alerts": findings("alerts", "c_alerts", ["dataset_id", "alert_id"], ["t_begin", "t_end", "task_id", "actual", "support_level"], ["t_begin", "t_end", "task_id", "actual"]),
    "diagnoses": findings("diags", "c_diags", ["dataset_id", "diag_id"], ["title", "conclusion", "confidence"]),
    "metrics": findings("mv", "c_mv", ["dataset_id", "metric_id"], ["value"], ["value"]),
    "resources": findings("resources", "c_resources", ["dataset_id", "kind", "id"], ["first", "second"], ["first", "second"]),
}
V["tot_findings"] = " UNION ALL ".join(f"SELECT dataset_id, finding FROM ({x}) AS y{i}" for i, x in enumerate(FOUND.values()))
WINDOWED = "SELECT dataset_id, count(*) AS rows, '{n}' AS \"table\" FROM {n} JOIN scope USING (dataset_id) WHERE t_begin < w_end AND t_end > w_begin GROUP BY dataset_id"
SQL = {
    "l01_lineage_records": "SELECT dataset_id, object_id, object_type, rule_id, open_event, close_event, array_to_string(sources, ',') AS sources, t_begin, t_end, reason_code FROM rec",
    "l02_lineage_windows": "SELECT dataset_id, object_id, window_ids, reasons FROM touch",
    "l03_lineage_status": """SELECT r.dataset_id, r.object_id, object_type, CASE WHEN object_type = 'hold' AND CAST(r.dataset_id AS bigint) % 2 = 1 THEN 'CAPABILITY_UNSUPPORTED' WHEN open_event IS NULL THEN 'INCOMPLETE_OPEN' WHEN close_event IS NULL OR reason_code IS NOT NULL THEN 'INCOMPLETE_CLOSE' WHEN reasons LIKE '%ALIGN_DEGRADED%' THEN 'ALIGNMENT_DEGRADED'
  WHEN reasons LIKE '%SEQ_GAP%' OR reasons LIKE '%BUFFER_OVERFLOW%' OR reasons LIKE '%IO_BACKPRESSURE%' THEN 'LOSS_AFFECTED' ELSE 'COMPLETE' END AS status, CAST(coalesce(n, 0) AS int) AS n_windows FROM rec AS r LEFT JOIN touch AS t ON t.dataset_id = r.dataset_id AND t.object_id = r.object_id""",
    "l04_lineage_backtrace": "SELECT s.dataset_id, object_id, s.event_uid, event_name, ts_raw FROM src AS s JOIN al AS e ON e.event_uid = s.event_uid",
    "l05_reused_ids": "SELECT dataset_id, event_uid, CAST(2 AS bigint) AS n FROM al WHERE seq % 50 = 0",
    "l06_lineage_subset": "SELECT object_id, open_event, close_event FROM rec WHERE object_id IN (SELECT slice_id FROM slices WHERE NOT trusted)",
    "l07_lineage_validate": """SELECT s.dataset_id, object_id, 'UNKNOWN_SOURCE' AS violation, event_uid AS detail FROM src AS s ANTI JOIN (SELECT event_uid FROM al WHERE seq % 40 <> 0) AS e USING (event_uid) UNION ALL SELECT dataset_id, object_id, 'NEGATIVE_RANGE', NULL FROM rec WHERE t_end < t_begin
  UNION ALL SELECT dataset_id, object_id, 'END_NOT_A_SOURCE', open_event || 'x' FROM coded WHERE code = 11 AND open_event IS NOT NULL UNION ALL SELECT dataset_id, object_id, 'UNKNOWN_WINDOW', 'uw:nowhere' FROM coded WHERE code = 7 UNION ALL SELECT dataset_id, object_id, 'LISTED_WITHOUT_OVERLAP', 'uw:far:' || dataset_id FROM coded WHERE code = 7
  UNION ALL SELECT c.dataset_id, object_id, 'UNLISTED_WINDOW', window_id FROM coded AS c JOIN windows AS w ON w.dataset_id = c.dataset_id AND w.t_begin <= c.t_end AND c.t_begin <= w.t_end WHERE code = 1
  UNION ALL SELECT dataset_id, object_id, 'RECORD_WITHOUT_OBJECT', NULL FROM coded WHERE code = 3 UNION ALL SELECT dataset_id, object_id || ':new', 'OBJECT_WITHOUT_RECORD', NULL FROM coded WHERE code = 9 UNION ALL SELECT dataset_id, object_id, 'OBJECT_DIFFERS', NULL FROM coded WHERE code = 5""",
    "e01_dependency_edges": "SELECT * FROM edges",
    "e02_edge_contract": "SELECT dataset_id, 'TIME_HINT' AS reason, count(*) AS n FROM edges WHERE seq_hint % 10 = 0 OR time_hint <= 0 GROUP BY dataset_id",
    "e03_seed_resolution": "SELECT s.dataset_id, kind, closure_id, ref, e.event_uid IS NOT NULL AS found FROM starts AS s LEFT JOIN (SELECT event_uid FROM al WHERE seq % 3 <> 0) AS e ON e.event_uid = s.ref",
    "e06_window_plan": "SELECT * FROM plan",
    "e06_unplanned_refs": "SELECT dataset_id, ref FROM want EXCEPT SELECT dataset_id, ref FROM hinted",
    "e07_read_plan_stats": """SELECT dataset_id, windows, CAST(span_total AS bigint) AS span_total, point_spans, target_refs, coalesce(matched_refs, 0) AS matched_refs, coalesce(unplanned_refs, 0) AS unplanned_refs, target_refs - coalesce(matched_refs, 0) AS missed_refs,
  round(coalesce(matched_refs, 0) * 1.0 / target_refs, 6) AS hit_rate FROM (SELECT dataset_id, count(*) AS windows, sum(t_end - t_begin) AS span_total, count(*) FILTER (WHERE t_begin = t_end) AS point_spans FROM plan GROUP BY dataset_id) AS p
  JOIN (SELECT dataset_id, count(*) AS target_refs FROM want GROUP BY dataset_id) AS w USING (dataset_id) LEFT JOIN (SELECT dataset_id, count(*) AS matched_refs FROM hits GROUP BY dataset_id) AS h USING (dataset_id)
  LEFT JOIN (SELECT dataset_id, count(*) AS unplanned_refs FROM (SELECT dataset_id, ref FROM want EXCEPT SELECT dataset_id, ref FROM hinted) AS x GROUP BY dataset_id) AS u USING (dataset_id)""",
    "e08_edge_partitions": "SELECT dataset_id, core_hint, count(*) AS edges, min(time_hint) AS t_min, max(time_hint) AS t_max, count(DISTINCT rule_family) AS families FROM edges GROUP BY ALL",
    "e09_validity_index": "SELECT dataset_id, object_id, count(*) AS rows, count(DISTINCT (scope, derivation)) AS variants, min(scope) AS least_scope, count(DISTINCT (scope, derivation)) > 1 AS conflict FROM valid_rows GROUP BY dataset_id, object_id",
    "v01_scope_identity": FOUND["scope"],
    "v02_alert_completeness": FOUND["alerts"],
    "v03_diagnosis_completeness": FOUND["diagnoses"],
    "v04_metric_completeness": FOUND["metrics"],
    "v05_resource_semantics": FOUND["resources"],
    "v08_validity_coverage": findings("valid", "c_valid", ["dataset_id", "object_id"], ["least_scope", "rows", "conflict"], ["rows"]),
    "k06_metric_export": "SELECT dataset_id, '{' || string_agg('\"' || metric_id || '\":' || format('{:.6f}', value), ',' ORDER BY metric_id) || '}' AS metrics FROM mv WHERE value IS NOT NULL GROUP BY dataset_id",
    "v01_verdict": """SELECT dataset_id, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(different, 0) AS different, CASE WHEN missing IS NULL THEN 'strict_pass' WHEN missing + different = 0 THEN 'bounded_pass' ELSE 'fail' END AS verdict FROM scope LEFT JOIN (
  SELECT dataset_id, count(*) FILTER (WHERE finding = 'missing') AS missing, count(*) FILTER (WHERE finding = 'extra') AS extra, count(*) FILTER (WHERE finding = 'different') AS different FROM tot_findings GROUP BY dataset_id) AS g USING (dataset_id)""",
    "v06_lost_edges": "SELECT dataset_id, edge_kind, task_id, obj_id, evidence_ref FROM kept_edges EXCEPT ALL SELECT dataset_id, edge_kind, task_id, obj_id, evidence_ref FROM c_both_edges",
    "v07_ref_closure": "SELECT dataset_id, category, ref_key FROM mentioned ANTI JOIN (SELECT event_uid AS ref_key FROM ce) AS e USING (ref_key) WHERE ref_key LIKE 'evt:%'",
    "k01_export_full": " UNION ALL ".join(f"SELECT dataset_id, count(*) AS rows, '{n}' AS \"table\" FROM {v} GROUP BY dataset_id" for n, v in (("events", "al"), ("states", "states"), ("slices", "slices"), ("holds", "holds"), ("waits", "waits"), ("irqs", "irqs"), ("windows", "windows"), ("alerts", "alerts"), ("diagnoses", "alerts"), ("metrics", "mv"))) + " UNION ALL SELECT dataset_id, count(*), 'anchors' FROM marks WHERE family = 'anchor' GROUP BY dataset_id",
    "k02_export_clipped": "SELECT dataset_id, count(*) AS rows, 'events' AS \"table\" FROM ce GROUP BY dataset_id UNION ALL SELECT dataset_id, count(*), 'windows' FROM kept_windows GROUP BY dataset_id UNION ALL " + " UNION ALL ".join(WINDOWED.format(n=n) for n in ("states", "slices", "holds", "waits", "irqs")),
    "k02_export_filtered": "SELECT dataset_id, count(*) AS rows, 'events' AS \"table\" FROM ce WHERE task_id = 3 GROUP BY dataset_id UNION ALL SELECT dataset_id, count(*), 'windows' FROM filtered_windows GROUP BY dataset_id UNION ALL "
    + " UNION ALL ".join(WINDOWED.format(n=n).replace(" GROUP BY", f" AND {c} GROUP BY") for n, c in (("states", "task_id = 3"), ("slices", "task_id = 3"), ("holds", "(task_id = 3 OR owner_task_id = 3)"), ("waits", "(task_id = 3 OR owner_task_id = 3)"), ("irqs", "delayed_task = 3"))),
    "s10_scan_package": "SELECT dataset_id, slice_id, t_begin, t_end FROM slices",
    "q07_package_ref_check": "SELECT dataset_id, category, ref_key FROM every_mention ANTI JOIN (SELECT event_uid AS ref_key FROM al WHERE seq % 60 <> 0) AS e USING (ref_key) WHERE ref_key LIKE 'evt:%'",
    "k04_ref_index": "SELECT dataset_id, event_uid AS ref_key, ts, core_id, seq FROM al",
    "k05_required_refs": "SELECT * FROM mentions WHERE ref_key IS NOT NULL",
    "k08_merge_segments": "SELECT event_uid, ts_raw FROM ev",
    "k09_scale_up": """SELECT e.dataset_id, e.core_id, seq + copy * max_seq AS seq, ts_raw + copy * cycle AS ts_raw, CAST(copy AS int) AS copy FROM ev AS e JOIN (SELECT dataset_id, core_id, max(seq) AS max_seq FROM ev GROUP BY ALL) AS m ON m.dataset_id = e.dataset_id AND m.core_id = e.core_id
  JOIN (SELECT dataset_id, max(ts_raw) - min(ts_raw) + 1 AS cycle FROM ev GROUP BY ALL) AS s ON s.dataset_id = e.dataset_id, range(3) AS c(copy)""",
    "k10_perturb_variant": """SELECT event_uid, CASE WHEN hit THEN ts_raw ELSE ts_raw + 37 END AS ts_raw, CASE WHEN hit THEN reason + 1 ELSE reason END AS reason, CASE WHEN hit AND reason IS NULL THEN prio + 1 ELSE prio END AS prio
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY seq) % 17 = 1 AS hit FROM ev) AS x""",
}
QUERIES = {k: over_trace(f, keep=k[0] in "lev" or k in ("k01_export_full", "k06_metric_export", "s10_scan_package", "q07_package_ref_check")) for k, f in TRACE.items()}
ORACLE = {k: with_views(v, V) for k, v in SQL.items()}
