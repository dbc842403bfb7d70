"""Provenance edges between references, closures over them under a budget, and what follows from those."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordering import following
from ..functions.quantiles import exact_quantiles
from ..functions.scans import scan
from ..functions.tables import settle


@dataclass
class Budget:
    depth: int = 4
    events: int = 512
    bytes: int = 1 << 20
    ratio: float = 4.0


#: Bytes that an event counts for in a budget.
EVENT_BYTES = 64


def dependency_edges(t, alerts: DataFrame, marks: DataFrame | None = None, snapshot: str = "s0") -> DataFrame:
    """Both directions of every relation; unique by (src, dst, relation, family), loops dropped.

    marks: dataset_id, family (anchor or context), mark, ref: what a reader has marked.
    """

    # a relation is one row with both directions until hints are found: low and high are its ends, up and down the priorities of low to high and back
    def ends(df, a, b, there, back, *more):
        up = a < b
        rows = df.where(a != b)
        return rows.select("dataset_id", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.when(up, there).otherwise(back).alias("up"), F.when(up, back).otherwise(there).alias("down"), *more)

    def pair(df, a, b, relation, family, there, back):
        return ends(df, a, b, there, back, F.lit(relation).alias("relation_kind"), F.lit(family).alias("rule_family"))

    pairs = [
        pair(t.slices, F.col("slice_id"), F.col("start_event"), "slice_start", "slice", 80, 80),
        pair(t.slices, F.col("slice_id"), F.col("end_event"), "slice_end", "slice", 80, 80),
        pair(t.states, F.col("seg_id"), F.col("cause_event"), "state_cause", "state", 85, 85),
        pair(t.holds.unionByName(t.waits).select("dataset_id", "evidence_ref", F.concat_ws(":", F.col("edge_kind"), "evidence_ref").alias("edge")), F.col("edge"), F.col("evidence_ref"), "edge_evidence", "resource", 90, 90),
        pair(alerts, F.col("alert_id"), F.col("evidence"), "alert_evidence", "alert", 100, 100),
        pair(alerts.withColumn("diag", F.concat(F.lit("diag:"), "alert_id")), F.col("diag"), F.col("alert_id"), "diagnosis_alert", "diagnosis", 95, 95),
    ]
    if marks is not None:
        pairs += [pair(marks.where(F.col("family") == f), F.col("mark"), F.col("ref"), f"{f}_ref", f, 92, 92) for f in ("anchor", "context")]
    by = ["dataset_id", "low", "high", "relation_kind", "rule_family"]
    related = reduce(DataFrame.unionByName, pairs).groupBy(*by).agg(F.max("up").alias("up"), F.max("down").alias("down"))
    hint = t.events.select("dataset_id", "event_uid", F.struct("ts", "core_id", "seq").alias("hint"))
    for end in ("low", "high"):
        related = related.join(hint.select("dataset_id", F.col("event_uid").alias(end), F.col("hint").alias(f"{end}_hint")), ["dataset_id", end], "left")

    # neighbours in the order of a trace bring their hints with them
    own = t.events.select("dataset_id", "ts", "core_id", "seq", F.struct("event_uid", F.struct("ts", "core_id", "seq").alias("hint")).alias("own"))
    follow = following(own, "dataset_id", ["ts", "core_id", "seq"], "own", long=t.is_long)
    one, other = F.col("own.event_uid"), F.col("next_own.event_uid")
    hints = [F.when(one < other, F.col(f"{x}.hint")).otherwise(F.col(f"{y}.hint")).alias(name) for name, x, y in (("low_hint", "own", "next_own"), ("high_hint", "next_own", "own"))]
    order = ends(follow, one, other, 50, 45, *hints).groupBy("dataset_id", "low", "high").agg(*[F.max(c).alias(c) for c in ("up", "down", "low_hint", "high_hint")])
    every = related.unionByName(order.withColumns({"relation_kind": F.lit("ref_ref"), "rule_family": F.lit("order")}))

    direction = lambda src, dst, p: F.struct(F.col(src).alias("src_ref"), F.col(dst).alias("dst_ref"), F.col(p).alias("priority"), F.coalesce(f"{dst}_hint", f"{src}_hint").alias("h"))
    both = every.select("dataset_id", "relation_kind", "rule_family", F.explode(F.array(direction("low", "high", "up"), direction("high", "low", "down"))).alias("e")).select("dataset_id", "relation_kind", "rule_family", "e.*")
    return both.select(
        "dataset_id", "src_ref", "dst_ref", "relation_kind", "rule_family", "priority",
        F.coalesce("h.ts", F.lit(0)).alias("time_hint"), F.col("h.core_id").alias("core_hint"), F.col("h.seq").alias("seq_hint"),
        F.concat_ws("|", F.least("src_ref", "dst_ref"), F.greatest("src_ref", "dst_ref")).alias("cycle_token"),
        F.lit(1).alias("estimate_events"), F.lit(EVENT_BYTES).alias("estimate_bytes"),
        F.sha2(F.concat_ws("|", F.lit(snapshot), "rule_family", "relation_kind", "src_ref", "dst_ref"), 256).alias("edge_hash"),
    )


def contract_rejects(edges: DataFrame) -> DataFrame:
    """Edges without usable hints or estimates, by reason."""
    reason = F.when(F.col("estimate_events") <= 0, "ESTIMATE_EVENTS").when(F.col("estimate_bytes") <= 0, "ESTIMATE_BYTES").when(F.col("time_hint") <= 0, "TIME_HINT")
    return edges.withColumn("reason", reason).where("reason is not null").groupBy("dataset_id", "reason").agg(F.count("*").alias("n"))


def seeds(alerts: DataFrame, events: DataFrame, kinds: list[str] | None = None, marks: DataFrame | None = None, manual: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Starts of closures: dataset_id, kind, closure_id, ref, and whether the ref is an event that exists.

    Alerts (of the kinds, if given) and their diagnoses start from their
    evidence, anchors and contexts from what they mark, manual refs
    (dataset_id, ref) from themselves, time spans (dataset_id, span, w_begin,
    w_end) from the events in them.
    """
    a = alerts.where(F.col("evidence").isNotNull() & (F.col("type").isin(kinds) if kinds else F.lit(True)))
    one = lambda df, kind, closure, ref: df.select("dataset_id", F.lit(kind).alias("kind"), closure.alias("closure_id"), F.col(ref).alias("ref"))
    parts = [one(a, "alert", F.col("alert_id"), "evidence"), one(a, "diagnosis", F.concat(F.lit("diag:"), "alert_id"), "evidence")]
    if marks is not None:
        parts += [one(marks.where(F.col("family") == f), f, F.col("mark"), "ref") for f in ("anchor", "context")]
    if manual is not None:
        parts.append(one(manual, "manual", F.concat(F.lit("manual:"), "ref"), "ref"))
    if spans is not None:
        parts.append(one(events.join(spans, "dataset_id").where("ts between w_begin and w_end"), "span", F.col("span"), "event_uid"))
    known = events.select("dataset_id", F.col("event_uid").alias("ref")).distinct().withColumn("found", F.lit(True))
    return reduce(DataFrame.unionByName, parts).join(known, ["dataset_id", "ref"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def closure(edges: DataFrame, starts: DataFrame, budget: Budget = Budget(), families: list[str] | None = None, events: DataFrame | None = None, frontier_limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Breadth-first closures of all starts at once, a job per round.

    starts: dataset_id, closure_id, ref. Returns the closed refs (dataset_id,
    closure_id, ref, depth, and the rule_family that led to it) and one row per
    closure: depth, seeds, refs, events, bytes, halt_reason (null if it ended by
    itself), frontier (refs that the halted round would have taken),
    truncated_frontier (those beyond ``frontier_limit``), missing (closed event
    refs that ``events`` lacks, where it is given) and mode. A round is checked
    against the budget before it is taken.
    """
    if families is not None:
        edges = edges.where(F.col("rule_family").isin(families))
    key = ["dataset_id", "closure_id"]
    closed = settle(starts.select(*key, "ref").distinct().select("*", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("rule_family")))
    frontier, halted = closed, None
    taken = ["dst_ref", "rule_family", "priority", "time_hint", "cycle_token", "estimate_events", "estimate_bytes", "edge_hash"]
    for depth in range(1, budget.depth + 2):
        # the edges are read once a round; all else goes by those that leave the frontier
        near = settle(frontier.select(*key, F.col("ref").alias("src_ref")).join(edges, ["dataset_id", "src_ref"]).select(*key, *taken))
        fresh = near.join(closed.select(*key, F.col("ref").alias("dst_ref")), [*key, "dst_ref"], "left_anti")
        best = W.partitionBy(*key, "dst_ref").orderBy(F.desc("priority"), "time_hint", "dst_ref", "edge_hash")
        nexts = settle(fresh.withColumn("n", F.row_number().over(best)).where("n = 1").select(*key, "dst_ref", "rule_family", "estimate_events", "estimate_bytes"))
        sizes = frontier.groupBy(*key).agg(F.count("*").alias("width"))
        used = closed.where("depth > 0").groupBy(*key).agg(F.count("*").alias("used"))
        cycles = near.groupBy(*key, "cycle_token").agg(F.count("*").alias("k")).groupBy(*key).agg(F.max("k").alias("most"))
        plan = nexts.groupBy(*key).agg(F.sum("estimate_events").alias("more"), F.sum("estimate_bytes").alias("more_bytes"), F.count("*").alias("n"))
        plan = plan.join(sizes, key).join(used, key, "left").join(cycles, key).withColumn("used", F.coalesce("used", F.lit(0)))
        reason = (
            F.when(F.col("most") > F.greatest(F.lit(8), F.col("width")), "CYCLE_INFLATION")
            .when(F.lit(depth > budget.depth), "DEPTH_LIMIT")
            .when(F.col("used") + F.col("more") > budget.events, "EVENT_LIMIT")
            .when(F.col("used") * EVENT_BYTES + F.col("more_bytes") > budget.bytes, "BYTE_LIMIT")
            .when(F.col("n") / F.col("width") > budget.ratio, "RHO_LIMIT")
        )
        plan = settle(plan.select(*key, reason.alias("halt_reason"), F.col("n").alias("frontier")))
        stopped = plan.where("halt_reason is not null")
        halted = stopped if halted is None else halted.unionByName(stopped)
        going = plan.where("halt_reason is null").select(*key)
        frontier = settle(nexts.join(going, key, "left_semi").select(*key, F.col("dst_ref").alias("ref"), F.lit(depth).alias("depth"), "rule_family"))
        if frontier.isEmpty():
            break
        closed = closed.unionByName(frontier)
    out = closed.groupBy(*key).agg(F.max("depth").alias("depth"), F.count_if(F.col("depth") == 0).alias("seeds"), F.count("*").alias("refs"))
    out = out.join(halted, key, "left").withColumn("frontier", F.coalesce("frontier", F.lit(0).cast("long")))
    lost = missing_refs(closed, events).groupBy(*key).agg(F.count("*").alias("missing")) if events is not None else None
    out = out.withColumn("missing", F.lit(0).cast("long")) if lost is None else out.join(lost, key, "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    emitted = F.col("refs") - F.col("seeds")
    reason = F.when(F.col("halt_reason").isNull() & (F.col("missing") > 0), "SIDECAR_MISMATCH").otherwise(F.col("halt_reason"))
    out = out.withColumn("halt_reason", reason)
    mode = F.when(F.col("halt_reason").isNull(), "exact").when(F.col("halt_reason").isin("CYCLE_INFLATION", "SIDECAR_MISMATCH"), "degraded").otherwise("bounded")
    return closed, out.select(
        *key, "depth", "seeds", "refs", emitted.alias("events"), (emitted * EVENT_BYTES).alias("bytes"), "halt_reason", "frontier",
        F.greatest(F.col("frontier") - frontier_limit, F.lit(0).cast("long")).alias("truncated_frontier"), "missing", mode.alias("mode"),
    )


def missing_refs(closed: DataFrame, events: DataFrame) -> DataFrame:
    """Closed event refs that no event has."""
    known = events.select("dataset_id", F.col("event_uid").alias("ref"))
    return closed.where(F.col("ref").startswith("evt:")).join(known, ["dataset_id", "ref"], "left_anti")


def closure_families(closed: DataFrame, events: DataFrame) -> DataFrame:
    """Per closure and rule family: refs that it brought, the deepest of them, and how many are missing among the events."""
    by = ["dataset_id", "closure_id", "rule_family"]
    seeds = F.coalesce("rule_family", F.lit("seed")).alias("rule_family")
    every = closed.select("dataset_id", "closure_id", seeds, "ref", "depth")
    lost = missing_refs(every, events).groupBy(*by).agg(F.count("*").alias("missing"))
    return every.groupBy(*by).agg(F.count("*").alias("refs"), F.max("depth").alias("depth")).join(lost, by, "left").na.fill(0, ["missing"])


def proof_digest(closures: DataFrame, budget: Budget = Budget(), snapshot: str = "s0", families: tuple[str, ...] = ("order", "slice", "state", "resource", "alert", "diagnosis", "anchor", "context")) -> DataFrame:
    """A digest per closure over thirteen facts: the SHA-256 of their JSON with sorted keys, as ``json.dumps`` writes it."""
    limits = {"C_events": budget.events, "D_max": budget.depth, "S_bytes": budget.bytes, "rho_max": float(budget.ratio)}
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    #: The names of the facts.
    facts = {
        "budget_vector": F.lit(json.dumps(limits)), "bytes_emitted": F.col("bytes"), "closed_ref_count": F.col("refs"), "closure_depth_reached": F.col("depth"), "closure_mode": text(F.col("mode")),
        "complete_wrt_rule_family": (F.col("mode") == "exact") & (F.col("missing") == 0), "events_emitted": F.col("events"), "frontier_halt_reason": text(F.coalesce("halt_reason", F.lit("FRONTIER_EMPTY"))),
        "missing_required_refs": F.col("missing"), "rule_family": F.lit(json.dumps(list(families), ensure_ascii=False)), "seed_ref_count": F.col("seeds"), "snapshot_id": F.lit(json.dumps(snapshot, ensure_ascii=False)), "truncated_frontier_count": F.col("truncated_frontier"),
    }
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value.cast("string")) for name, value in facts.items()])
    return closures.select("dataset_id", "closure_id", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)).alias("proof"))


def proof_check(proofs: DataFrame, closures: DataFrame, budget: Budget = Budget(), snapshot: str = "s0") -> DataFrame:
    """dataset_id, closure_id, status of stated proofs against recomputed ones: valid, changed, unknown (no such closure) or unproved."""
    again = proof_digest(closures, budget, snapshot).withColumnRenamed("proof", "again")
    j = proofs.join(again, ["dataset_id", "closure_id"], "full")
    status = F.when(F.col("again").isNull(), "unknown").when(F.col("proof").isNull(), "unproved").when(F.col("proof") == F.col("again"), "valid").otherwise("changed")
    return j.select("dataset_id", "closure_id", status.alias("status"))


def window_plan(hints: DataFrame, keys: list[str], refs: DataFrame, index: DataFrame, most_gap: int = 50_000, long: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read spans, planned refs with their span, refs without a plan) for wanted refs.

    hints: keys (dataset first, core_id among them), ref, begin, end, seq_begin, seq_end (nulls: any);
    refs: dataset, ref; index: keys, ref_key, ts, seq. Hint ranges of a key are merged when at most the median
    width of the dataset's hints (clamped) apart; a ref without a hint is planned as the point that the index has for it.
    """
    dataset = keys[0]
    wanted = refs.select(dataset, "ref").distinct()
    h = hints.select(*keys, "ref", F.least("begin", "end").alias("begin"), F.greatest("begin", "end").alias("end"), "seq_begin", "seq_end", F.lit(1).alias("edges")).join(wanted, [dataset, "ref"], "left_semi")
    h = settle(h)
    unhinted = settle(wanted.join(h.select(dataset, "ref"), [dataset, "ref"], "left_anti"))
    known = index.select(*keys, F.col("ref_key").alias("ref"), F.col("ts").alias("begin"), F.col("ts").alias("end"), F.col("seq").alias("seq_begin"), F.col("seq").alias("seq_end"), F.lit(0).alias("edges"))
    points = known.join(unhinted, [dataset, "ref"], "left_semi")
    rows = settle(h.select(points.columns).unionByName(points))
    unplanned = wanted.join(rows.select(dataset, "ref"), [dataset, "ref"], "left_anti")

    gap = exact_quantiles(rows, [dataset], F.col("end") - F.col("begin"), {"median": 0.5}).select(dataset, F.least(F.greatest(F.floor("median"), F.lit(0)), F.lit(most_gap)).alias("gap"))
    order = ["begin", "end", "ref", "edges", "tie"]
    # hints that are alike in all else are put in order by their place
    j = scan(rows.withColumn("tie", F.monotonically_increasing_id()), keys, order, highest={"reach": F.col("end")}, long=long).join(gap, dataset)
    opens = F.when(F.col("reach").isNull() | (F.col("begin") > F.col("reach") + F.col("gap")), 1).otherwise(0)
    j = settle(scan(j, keys, order, total={"island": opens}, long=long))
    # a bound on the seq holds for the span only if all of its ranges have one
    bound = lambda f, c: F.when(F.count(c) == F.count("*"), f(c)).alias(c)
    spans = j.groupBy(*keys, "island").agg(F.min("begin").alias("t_begin"), F.max("end").alias("t_end"), bound(F.min, "seq_begin"), bound(F.max, "seq_end"), F.sum("edges").alias("edges"), F.count_distinct("ref").alias("refs"))
    return spans, j.select(*keys, "island", "ref").distinct(), unplanned


def read_plan_stats(spans: DataFrame, planned: DataFrame, unplanned: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Per dataset: windows (one seek each), their span, point spans, target refs, those found by reading the plan, missed and unplanned ones, and the hit rate.

    events: keys, event_uid, ts, seq. A ref is found if its event lies in one of its spans.
    """
    dataset = keys[0]
    read = planned.join(spans, [*keys, "island"]).join(events.select(*keys, F.col("event_uid").alias("ref"), "ts", "seq"), [*keys, "ref"])
    read = read.where("ts between t_begin and t_end and (seq_begin is null or seq >= seq_begin) and (seq_end is null or seq <= seq_end)")
    parts = [
        spans.groupBy(dataset).agg(F.count("*").alias("windows"), F.sum(F.col("t_end") - F.col("t_begin")).alias("span_total"), F.count_if(F.col("t_begin") == F.col("t_end")).alias("point_spans")),
        planned.unionByName(unplanned, allowMissingColumns=True).groupBy(dataset).agg(F.count_distinct("ref").alias("target_refs")),
        read.groupBy(dataset).agg(F.count_distinct("ref").alias("matched_refs")),
        unplanned.groupBy(dataset).agg(F.count("*").alias("unplanned_refs")),
    ]
    g = reduce(lambda a, b: a.join(b, dataset, "full"), parts).na.fill(0)
    hit = F.when(F.col("target_refs") == 0, 1.0).otherwise(F.round(F.col("matched_refs") / F.col("target_refs"), 6))
    return g.withColumns({"missed_refs": F.col("target_refs") - F.col("matched_refs"), "hit_rate": hit})


def edge_partitions(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dataset_id", "core_hint").agg(F.count("*").alias("edges"), F.min("time_hint").alias("t_min"), F.max("time_hint").alias("t_max"), F.count_distinct("rule_family").alias("families"))


def validity_index(rows: DataFrame) -> DataFrame:
    """rows: dataset_id, object_id, scope, derivation. Rows per object, and whether its variants conflict."""
    g = rows.groupBy("dataset_id", "object_id").agg(F.count("*").alias("rows"), F.count_distinct("scope", "derivation").alias("variants"), F.min("scope").alias("least_scope"))
    return g.withColumn("conflict", F.col("variants") > 1)


def consumer_mode(closures: DataFrame, validity: DataFrame) -> DataFrame:
    """What a reader may do with a closure, by its mode and the validity of its references."""
    j = closures.join(validity, ["dataset_id", "closure_id"], "left")
    mode = F.when((F.col("mode") == "degraded") | F.coalesce(F.col("conflicts") > 0, F.lit(False)), "REJECT_AUTOMATION").when((F.col("mode") == "exact") & F.coalesce(F.col("untrusted") == 0, F.lit(True)), "ALLOW_COMPARE").otherwise("REFERENCE_ONLY")
    return j.select("dataset_id", "closure_id", mode.alias("consumer_mode"))
