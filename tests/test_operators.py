"""Operators that SQL can't check: overlap join, closures, chunk files and converters."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from tracefold.functions import ordering, quantiles
from tracefold.operators import evidence, index, stats
from tracefold.operators.intervals import overlap_buckets, overlap_join
from tracefold.plans.trace import tables
from tracefold.sources import chunks, segments, text_traces


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(1)
    make = lambda n, tag: [("d", tag * 1000 + i, b := rng.randrange(2000), b + rng.choice([0, 1, 5, 40, 900])) for i in range(n)]
    left, right = make(60, 1), make(60, 2)
    l = spark.createDataFrame(left, "k string, i long, t_begin long, t_end long")
    r = spark.createDataFrame(right, "k string, j long, t_begin long, t_end long")
    for closed in (True, False):
        got = sorted((x.i, x.j) for x in overlap_join(l, r, ["k"], closed).collect())
        want = sorted((a[1], b[1]) for a in left for b in right if (a[2] <= b[3] and b[2] <= a[3] if closed else a[2] < b[3] and b[2] < a[3]))
        assert got == want


def test_order_within_long_keys(spark):
    """Numbers, followers and neighbours by time cells, against sorting, with ties, one-row keys and empty cells."""
    rng = random.Random(6)
    rows = [("a", rng.choice([rng.randrange(40), rng.randrange(100_000)]), i) for i in range(400)] + [("b", 7, 0), ("c", 5, 1), ("c", 5, 2)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long").withColumn("uid", F.concat_ws(":", "k", "ts", "seq"))
    ordered = {k: sorted((t, q) for x, t, q in rows if x == k) for k in "abc"}
    name = lambda k, r: f"{k}:{r[0]}:{r[1]}"
    got = {r.uid: r.n for r in ordering.numbered(df, "k", ["ts", "seq"], "n", cells=8).collect()}
    assert got == {name(k, r): i for k in "abc" for i, r in enumerate(ordered[k], 1)}
    got = {r.uid: r.next_uid for r in ordering.following(df, "k", ["ts", "seq"], "uid", cells=8).collect()}
    assert got == {name(k, r): name(k, ordered[k][i + 1]) if i + 1 < len(ordered[k]) else None for k in "abc" for i, r in enumerate(ordered[k])}
    probes = [("a", rng.randrange(-50, 100_100), i) for i in range(80)] + [("a", t, 100 + i) for i, (t, _) in enumerate(ordered["a"][:30])] + [("c", 5, 1), ("c", 9, 2)]
    near = ordering.neighbours(spark.createDataFrame(probes, "k string, at long, p long"), df.select("k", F.col("ts").alias("at"), F.struct("ts", "seq").alias("v")), "k", "at", "v", cells=8)
    first = {(k, t): min(r for r in ordered[k] if r[0] == t) for k in "abc" for t, _ in ordered[k]}
    for r in near.collect():
        times = sorted({t for t, _ in ordered[r.k]})
        before, after = [t for t in times if t < r.at], [t for t in times if t >= r.at]
        assert (tuple(r.before) if r.before else None) == (first[r.k, before[-1]] if before else None)
        assert (tuple(r.after) if r.after else None) == (first[r.k, after[0]] if after else None)
    assert near.count() == len(probes)


def test_chain_counts_equal_the_chains(spark):
    rng = random.Random(7)
    waits = [("d", rng.choice([None, 1, 2, 3]), rng.randrange(3), rng.choice([None, 8, 9]), f"w{i}", True) for i in range(60)]
    holds = [("d", rng.choice([1, 2, None]), rng.randrange(4), f"h{i}", True) for i in range(30)]
    w = spark.createDataFrame(waits, "dataset_id string, obj_id long, task_id long, owner_task_id long, evidence_ref string, trusted boolean")
    h = spark.createDataFrame(holds, "dataset_id string, obj_id long, task_id long, evidence_ref string, trusted boolean")
    chains = index.wait_chains(w, h).groupBy("dataset_id").agg(F.count("*").alias("chains"), F.count_distinct("task_id", "obj_id", "owner_task_id").alias("paths"))
    assert [tuple(r) for r in index.chain_counts(w, h).collect()] == [tuple(r) for r in chains.collect()]


def test_exact_quantiles(spark):
    """Against sorting: ties, single values, nulls, null keys and keys without values, in one cell and in many."""
    rng = random.Random(4)
    rows = [(k, rng.choice([None, rng.randrange(5), rng.randrange(10_000)])) for k in ("a", "b", None) for _ in range(150)] + [("one", 7), ("two", 1), ("two", 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    ps = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    want = set()
    for key in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == key and x is not None)
        if v:
            at = lambda p: (len(v) - 1) * p  # noqa: E731, B023
            inter = [v[int(at(p))] if at(p) == int(at(p)) else v[int(at(p))] + (v[int(at(p)) + 1] - v[int(at(p))]) * (at(p) - int(at(p))) for p in ps.values()]
            want.add((key, len(v), *[round(x, 6) for x in inter], v[max(1, math.ceil(0.95 * len(v))) - 1]))
    for long in (False, True):
        got = quantiles.exact_quantiles(df, ["k"], "v", ps, {"near": 0.95}, long=long, cells=7).collect()
        assert {(r.k, r.n, *[round(r[c], 6) for c in ps], r.near) for r in got} == want


def test_bucket_parts_sum_to_one(spark):
    i = spark.createDataFrame([("d", 3, 3), ("d", 0, 100), ("d", 10, 33)], "dataset_id string, t_begin long, t_end long")
    w = spark.createDataFrame([("d", 0, 100)], "dataset_id string, w_begin long, w_end long")
    parts = overlap_buckets(i, w, 7).groupBy("t_begin").sum("part").collect()
    assert all(abs(p[1] - 1) < 1e-9 for p in parts)


def test_closure_depths_budget_and_cycles(spark):
    edge = lambda a, b, p=50: ("d", a, b, "r", "order", p, 1, 0, 1, "|".join(sorted((a, b))), 1, 64, f"{a}>{b}")
    rows = [edge("a", "b"), edge("b", "a"), edge("b", "c"), edge("c", "d"), edge("d", "e"), edge("e", "f"), edge("x", "y")] + [edge("x", f"y{i}") for i in range(9)]
    schema = "dataset_id string, src_ref string, dst_ref string, relation_kind string, rule_family string, priority int, time_hint long, core_hint int, seq_hint long, cycle_token string, estimate_events int, estimate_bytes int, edge_hash string"
    edges = spark.createDataFrame(rows, schema)
    starts = spark.createDataFrame([("d", "one", "a"), ("d", "two", "e"), ("d", "wide", "x")], "dataset_id string, closure_id string, ref string")
    closed, closures = evidence.closure(edges, starts)
    by = {r.closure_id: r for r in closures.collect()}
    assert (by["one"].refs, by["one"].halt_reason, by["one"].mode) == (5, "DEPTH_LIMIT", "bounded")
    assert (by["two"].refs, by["two"].halt_reason, by["two"].mode) == (2, None, "exact")
    assert (by["wide"].refs, by["wide"].halt_reason) == (1, "RHO_LIMIT")
    assert sorted((r.ref, r.depth) for r in closed.where("closure_id = 'one'").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    proofs = evidence.proof_digest(closures)
    assert proofs.select("proof").distinct().count() == 3
    stated = proofs.withColumn("proof", F.when(F.col("closure_id") == "one", F.lit("sha256:0")).otherwise(F.col("proof"))).where("closure_id <> 'wide'").unionByName(spark.createDataFrame([("d", "gone", "x")], "dataset_id string, closure_id string, proof string"))
    assert {r.closure_id: r.status for r in evidence.proof_check(stated, closures).collect()} == {"one": "changed", "two": "valid", "wide": "unproved", "gone": "unknown"}
    facts = {"bytes_emitted": 256, "closed_ref_count": 5, "closure_depth_reached": 4, "closure_mode": "bounded", "complete_wrt_rule_family": False, "events_emitted": 4, "frontier_halt_reason": "DEPTH_LIMIT", "missing_required_refs": 0}
    facts |= {"seed_ref_count": 1, "snapshot_id": 'é"1', "truncated_frontier_count": 0, "rule_family": ["order", "é"], "budget_vector": {"D_max": 4, "C_events": 512, "S_bytes": 1 << 20, "rho_max": 4.0}}
    proof = {r.closure_id: r.proof for r in evidence.proof_digest(closures, snapshot='é"1', families=("order", "é")).collect()}
    assert proof["one"] == "sha256:" + hashlib.sha256(json.dumps(facts, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    validity = spark.createDataFrame([("d", "one", 0, 0), ("d", "two", 1, 0)], "dataset_id string, closure_id string, conflicts long, untrusted long")
    assert {r.closure_id: r.consumer_mode for r in evidence.consumer_mode(closures, validity).collect()} == {"one": "REFERENCE_ONLY", "two": "REJECT_AUTOMATION", "wide": "REFERENCE_ONLY"}


def test_closures_count_frontier_families_and_lost_events(spark):
    edge = lambda a, b, family, p=50: ("d", a, b, "r", family, p, 1, 0, 1, "|".join(sorted((a, b))), 1, 64, f"{a}>{b}{family}")
    rows = [edge("evt:a", "evt:b", "order"), edge("evt:b", "seg:1", "state"), edge("evt:a", "seg:2", "state"), edge("evt:b", "evt:c", "order"), edge("evt:b", "evt:c", "slice", 90)]
    rows += [edge("evt:w", f"evt:w{i}", "order") for i in range(9)]
    schema = "dataset_id string, src_ref string, dst_ref string, relation_kind string, rule_family string, priority int, time_hint long, core_hint int, seq_hint long, cycle_token string, estimate_events int, estimate_bytes int, edge_hash string"
    starts = spark.createDataFrame([("d", "x", "evt:a"), ("d", "wide", "evt:w"), ("d", "whole", "seg:1")], "dataset_id string, closure_id string, ref string")
    events = spark.createDataFrame([("d", f"evt:{x}") for x in ("a", "b", "w")], "dataset_id string, event_uid string")
    closed, closures = evidence.closure(spark.createDataFrame(rows, schema), starts, events=events, frontier_limit=4)
    got = {r.closure_id: (r.refs, r.halt_reason, r.frontier, r.truncated_frontier, r.missing, r["mode"]) for r in closures.collect()}
    assert got == {"x": (5, "SIDECAR_MISMATCH", 0, 0, 1, "degraded"), "wide": (1, "RHO_LIMIT", 9, 5, 0, "bounded"), "whole": (1, None, 0, 0, 0, "exact")}
    families = {(r.closure_id, r.rule_family): (r.refs, r.depth, r.missing) for r in evidence.closure_families(closed, events).collect() if r.closure_id == "x"}
    assert families == {("x", "seed"): (1, 0, 0), ("x", "order"): (1, 1, 0), ("x", "state"): (2, 2, 0), ("x", "slice"): (1, 2, 1)}


def test_window_plan_covers_hints_and_points(spark):
    key = "dataset_id string, core_id int"
    hints = spark.createDataFrame([("d", 0, "a", 10, 20, 5, 6), ("d", 0, "b", 24, 22, None, None), ("d", 0, "c", 60, 70, 7, 9), ("d", 1, "a", 12, 14, 1, 2), ("d", 0, "unasked", 30, 40, 1, 1)], f"{key}, ref string, begin long, end long, seq_begin long, seq_end long")
    refs = spark.createDataFrame([("d", r) for r in ("a", "b", "c", "point", "nowhere", "a")], "dataset_id string, ref string")
    index = spark.createDataFrame([("d", 0, "point", 71, 11), ("d", 0, "a", 15, 5)], f"{key}, ref_key string, ts long, seq long")
    for long in (False, True):
        spans, planned, unplanned = evidence.window_plan(hints, ["dataset_id", "core_id"], refs, index, most_gap=50, long=long)
        # the median width of 10, 2, 10, 2 and 0 is 2
        got = sorted((r.core_id, r.t_begin, r.t_end, r.seq_begin, r.seq_end, r.edges, r.refs) for r in spans.collect())
        assert got == [(0, 10, 24, None, None, 2, 2), (0, 60, 71, 7, 11, 1, 2), (1, 12, 14, 1, 2, 1, 1)]
        assert [r.ref for r in unplanned.collect()] == ["nowhere"]
        events = spark.createDataFrame([("d", 0, "a", 15, 5), ("d", 0, "c", 80, 8), ("d", 0, "point", 71, 11), ("d", 0, "b", 23, 1)], f"{key}, event_uid string, ts long, seq long")
        (s,) = evidence.read_plan_stats(spans, planned, unplanned, events, ["dataset_id", "core_id"]).collect()
        assert (s.windows, s.span_total, s.point_spans, s.target_refs, s.matched_refs, s.missed_refs, s.unplanned_refs, s.hit_rate) == (3, 27, 0, 5, 3, 2, 1, 0.6)


def test_version_chains_and_cycles(spark):
    rows = [("good", i, i - 1 if i else None) for i in range(9)] + [("beside", i, i - 1 if i else None) for i in range(4)] + [("beside", 100 + i, 100 + (i + 1) % 5) for i in range(5)]
    rows += [("tail", 1, 2), ("tail", 2, 3), ("tail", 3, 4), ("tail", 4, 2), ("two", 1, 2), ("two", 2, 1), ("two", 7, 7), ("fork", 1, None), ("fork", 2, 1), ("fork", 3, 1), ("lost", 5, 99), ("again", 1, None), ("again", 1, None), ("alone", 1, None)]
    frame = spark.createDataFrame(rows, "k string, version long, prior long")
    got = {r.k: (r.versions, r.repeated, r.leaves, r.forks, r.dangling, r.roots, r.cycles, r.cycle_records, r.current) for r in stats.current_version(frame, "k").collect()}
    assert got == {
        "good": (9, 0, 1, 0, 0, 1, 0, 0, 8), "beside": (9, 0, 1, 0, 0, 1, 1, 5, None), "tail": (4, 0, 1, 1, 0, 0, 1, 3, None), "two": (3, 0, 0, 0, 0, 0, 2, 3, None), "fork": (3, 0, 2, 1, 0, 1, 0, 0, None),
        "lost": (1, 0, 1, 0, 1, 0, 0, 0, None), "again": (1, 1, 1, 0, 0, 2, 0, 0, None), "alone": (1, 0, 1, 0, 0, 1, 0, 0, 1),
    }
    assert sorted((r.k, r.cycle, r.length) for r in stats.version_cycles(frame, "k").collect()) == [("beside", 100, 5), ("tail", 2, 3), ("two", 1, 2), ("two", 7, 1)]
    assert stats.current_version(frame.where("false"), "k").count() == 0


def test_chunk_files_round_trip_and_damage(spark, tmp_path):
    rows = [{"event_name": ("TASK_BLOCK", "CTX_SWITCH", "IRQ_ENTER", "SYNC_CALIB")[i % 4], "seq": i, "ts_raw": 100 + i, "task_id": i % 3, "reason": 2, "irq_id": 4, "prev_task_id": 1, "next_task_id": i % 5} for i in range(1, 41)]
    good = chunks.encode_segment("run", [chunks.encode_chunk(0, rows[:20]), chunks.encode_chunk(1, rows[20:])], cores=2)
    (tmp_path / "a.bin").write_bytes(good)
    got = chunks.scan_trace(chunks.files(spark, str(tmp_path))).collect()
    assert sorted((r.core_id, r.seq, r.ts_raw, r.event_name) for r in got) == [(0 if r["seq"] <= 20 else 1, r["seq"], r["ts_raw"], r["event_name"]) for r in rows]
    assert all((r.prev_task_id, r.next_task_id, r.reason) == (1, r.seq % 5, 2) for r in got if r.event_name == "CTX_SWITCH") and all(r.crc_ok for r in got)
    first = chunks.TRACE_HEADER.size + chunks.SEGMENT_HEADER.size + chunks.CHUNK_HEADER.size
    bad = bytearray(good)
    bad[first + 30] ^= 1
    cases = {"bad": bytes(bad) + b"cut", "short": good[:-3], "head": good[:20], "none": b"", "mark": b"x" + good[1:], "old": chunks.TRACE_HEADER.pack(chunks.TRACE_MARK, 1, 1, 1, 1, 1, 1, b"", b"", b"") + chunks.encode_chunk(3, rows[:2])}
    segments = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    catalog = chunks.chunk_catalog(segments)
    found = {k: [r.problem for r in catalog.where(f"path = '{k}'").orderBy("chunk_id").collect()] for k in cases}
    assert found == {"bad": [None, None, "TRUNCATED_CHUNK"], "short": [None, "TRUNCATED_CHUNK"], "head": ["TRUNCATED_HEADER"], "none": ["TRUNCATED_HEADER"], "mark": ["BAD_MARK"], "old": [None]}
    read = chunks.scan_trace(segments).collect()
    assert {(r.chunk_id, r.crc_ok) for r in read if r.path == "bad"} == {(0, False), (1, True)} and len([r for r in read if r.path == "old"]) == 2
    cut = chunks.CHUNK_HEADER.pack(chunks.CHUNK_MARK, 1, 0, 3, 30, 1, 2, 1, 3, 1, 0) + chunks.encode_event(0, "SYNC_CALIB", 1, 1, {}) + b"zz"
    (one, two) = chunks.scan_trace(spark.createDataFrame([("p", bytearray(chunks.encode_segment("r", [cut])))], "path string, content binary")).collect()
    assert {one.problem, two.problem} == {None, "TRUNCATED_EVENT"}


def test_vcd_and_logic_csv(spark, tmp_path):
    (tmp_path / "x.vcd").write_text("$var wire 1 a sig $end\n#5\n1a\n0zz\n#9\nxa\n0a\n#7\n1a\n")
    rows, problems = text_traces.scan_vcd(spark, str(tmp_path / "x.vcd"))
    assert sorted((r.timestamp, r.identifier, r.value) for r in rows.collect()) == [(5, "a", 1), (7, "a", 1), (9, "a", 0)]
    assert sorted(r.reason for r in problems.collect()) == ["TIMESTAMP_REGRESSION", "UNSUPPORTED_VALUE"]
    (tmp_path / "l.csv").write_text("; logic\nTime(s),CH0,CH1\n0.0,0,0\n0.1,0,0\n0.2,1,0\n0.3,1,1\n0.4,0,1\n0.5,1,1\n")
    changed, edges = text_traces.scan_logic_csv(spark, str(tmp_path / "l.csv"), ["ch0", "ch1"])
    assert sorted(r.time for r in changed.collect()) == [0.0, 0.2, 0.3, 0.4, 0.5]
    assert sorted(r.time for r in edges.collect()) == [0.2, 0.5]



def test_segments_are_read_by_seeking(spark, tmp_path):
    """Bytes read follow the chunks that are wanted, in files split over many partitions and in one of 3 GB."""
    rows = lambda core, a, b: [{"event_name": "TASK_READY", "seq": i, "ts_raw": 1000 * core + i, "task_id": i} for i in range(a, b)]
    parts = [(core, a) for core in (0, 1) for a in range(0, 100, 10)]
    content = chunks.encode_segment("run", [chunks.encode_chunk(core, rows(core, a, a + 10)) for core, a in parts], cores=2)
    folder = str(tmp_path / "many")
    segments.write_segments(spark.createDataFrame([(n, bytearray(content)) for n in "abc"], "path string, content binary"), folder)
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["a.seg", "b.seg", "c.seg"]

    every = segments.read_events(spark, folder, split=500)
    assert every.rdd.getNumPartitions() > 20 and every.count() == 600
    got = every.where("core_id = 1 and seq >= 35 and seq < 52")
    assert sorted((r.path[-5], r.seq) for r in got.collect()) == [(n, i) for n in "abc" for i in range(35, 52)]
    assert segments.read_events(spark, folder, split=500).where("core_id = 9").count() == 0

    reader = segments.SegmentReader(f"{folder}/a.seg", "events", 500)
    wanted = list(reader.pushFilters([segments.EqualTo(("core_id",), 1), segments.GreaterThanOrEqual(("seq",), 35), segments.LessThan(("seq",), 52)]))
    assert len(wanted) == 3  # Spark still tests the rows
    seen = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert seen == 30 and len(reader.partitions()) < 20

    opened = segments.Segment(f"{folder}/a.seg")
    headers = chunks.TRACE_HEADER.size + chunks.SEGMENT_HEADER.size + len(parts) * chunks.CHUNK_HEADER.size
    catalog = list(opened.chunks())
    assert len(catalog) == 20 and opened.bytes_read == headers < len(content) / 3
    list(opened.events(catalog[3]))
    assert opened.bytes_read == headers + catalog[3]["payload_size"]

    huge = tmp_path / "huge.seg"
    with huge.open("wb") as f:
        f.write(chunks.encode_segment("huge", []))
        for i in range(3):  # a hole of 1 GB behind each small chunk
            f.write(chunks.encode_chunk(i, rows(i, 1, 4)))
            f.write(chunks.CHUNK_HEADER.pack(chunks.CHUNK_MARK, 1, 7, 0, 1 << 30, 0, 0, 0, 0, 1, 0))
            f.seek(1 << 30, 1)
        f.truncate()
    assert huge.stat().st_size > 3 << 30
    found = segments.catalog(spark, str(huge))
    assert sorted((r.chunk_id, r.core_id, r.problem) for r in found.collect()) == [(i, i // 2 if i % 2 == 0 else 7, None) for i in range(6)]
    spans = [(str(huge), 1, 0, 5000, None, 2, ["1:1", "1:9"]), (str(huge), 2, 2000, 2002, None, None, None)]
    kept, counters = segments.read_spans(found, spark.createDataFrame(spans, "path string, core_id int, t_begin long, t_end long, seq_begin long, seq_end long, refs array<string>"))
    assert sorted((r.core_id, r.seq) for r in kept.collect()) == [(1, 1), (2, 1), (2, 2)]
    (c,) = counters.collect()
    size = chunks.CHUNK_HEADER.size + 3 * (chunks.EVENT_HEADER.size + 10)
    assert (c.chunks, c.seeks, c.bytes, c.decoded, c.kept, c.target_refs, c.missed_refs, c.hit_rate, c.span_total) == (6, 2, 2 * size, 6, 3, 2, 1, 0.5, 5002)
    assert segments.read_events(spark, str(huge)).where("core_id < 7").count() == 9


def test_damaged_segment_files(spark, tmp_path):
    """By seeking, a damaged file gives the catalogue rows that its whole content gives."""
    good = chunks.encode_segment("run", [chunks.encode_chunk(c, [{"event_name": "TS_CALIB", "seq": i, "ts_raw": i} for i in range(5)]) for c in (0, 1)])
    old = chunks.TRACE_HEADER.pack(chunks.TRACE_MARK, 1, 1, 1, 1, 1, 1, b"", b"", b"") + chunks.encode_chunk(3, [])
    cases = {"good": good, "short": good[:-3], "tail": good + b"cut", "mark": b"x" + good[1:], "head": good[:20], "none": b"", "meta": good[:110], "old": old, "long": good + b"y" * 90}
    for name, content in cases.items():
        (tmp_path / f"{name}.seg").write_bytes(content)
    frame = spark.createDataFrame([(f"{tmp_path}/{k}.seg", bytearray(v)) for k, v in cases.items()], "path string, content binary")
    columns = [c for c in chunks.chunk_catalog(frame).columns if c != "payload"]
    assert sorted(map(str, segments.catalog(spark, str(tmp_path)).select(columns).collect())) == sorted(map(str, chunks.chunk_catalog(frame).select(columns).collect()))
    assert segments.read_events(spark, str(tmp_path)).count() == chunks.scan_trace(frame).count()


def test_package_files_do_not_grow_with_datasets(spark, tmp_path):
    """A package has no folder a dataset, keeps ids as strings and sorts its files by dataset."""
    from pathlib import Path
    from types import SimpleNamespace

    from tracefold.operators import export

    rows = spark.range(400).select(F.format_string("%03d", F.col("id") % 40).alias("dataset_id"), "id").repartition(3)
    export.export_full(SimpleNamespace(**dict.fromkeys(export.TABLES, rows)), str(tmp_path))
    back = export.scan_package(spark, str(tmp_path))["events"]
    assert back.dtypes[0] == ("dataset_id", "string") and sorted(back.collect()) == sorted(rows.collect())
    files = list(Path(tmp_path, "events").rglob("*.parquet"))
    assert len(files) == 3
    for f in files:
        ids = [r.dataset_id for r in spark.read.parquet(str(f)).collect()]
        assert ids == sorted(ids)


def test_short_keys_are_numbered_by_one_window(spark):
    """Keys that fit a task take no table of cells, and give the same numbers and followers."""
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 37 % 101).alias("ts"), F.col("id").alias("seq"), F.col("id").alias("uid"))
    for f, value in ((ordering.numbered, "n"), (ordering.following, "uid")):
        plain, cells = (f(df, "k", ["ts", "seq"], value, long=long) for long in (False, True))
        columns = ["k", "seq", "n" if value == "n" else "next_uid"]
        assert {tuple(r) for r in plain.select(columns).collect()} == {tuple(r) for r in cells.select(columns).collect()}
        assert "Join" not in plain._jdf.queryExecution().toString() and "Join" in cells._jdf.queryExecution().toString()


def test_window_lists_are_compared_as_lists(spark):
    """Unlisted, unknown and untouched windows, with the overlap join planned at most once."""
    from tracefold.operators import lineage

    rec = spark.createDataFrame([("d", "a", ["e"], "e", "e", 0, 10), ("d", "b", ["e"], "e", "e", 20, 30), ("d", "c", ["e"], "e", "e", 40, 50)], "dataset_id string, object_id string, sources array<string>, open_event string, close_event string, t_begin long, t_end long")
    windows = spark.createDataFrame([("d", "w1", 10, 20), ("d", "w2", 25, 26)], "dataset_id string, window_id string, t_begin long, t_end long")
    listed = spark.createDataFrame([("d", "a", ["w1", "w1", "no"]), ("d", "b", ["w2"]), ("d", "c", ["w2"])], "dataset_id string, object_id string, window_ids array<string>")
    events = spark.createDataFrame([("d", "e")], "dataset_id string, event_uid string")
    got = lineage.violations(rec, events, windows, listed, rec.select("dataset_id", "object_id", "t_begin", "t_end"))
    assert {tuple(r)[1:] for r in got.collect()} == {("a", "UNKNOWN_WINDOW", "no"), ("b", "UNLISTED_WINDOW", "w1"), ("c", "LISTED_WITHOUT_OVERLAP", "w2")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("_join_level") == 0


def test_closure_reads_the_edges_once_a_round(spark):
    columns = "dataset_id string, src_ref string, dst_ref string, rule_family string, priority int, time_hint long, cycle_token string, estimate_events int, estimate_bytes int, edge_hash string"
    rows = [("d", f"n{i}", f"n{i + 1}", "order", 50, i, f"n{i}|n{i + 1}", 1, 64, f"h{i}") for i in range(8)]
    read = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(lambda r: (read.add(1), r)[1]), columns)
    closed, _ = evidence.closure(edges, spark.createDataFrame([("d", "c", "n0")], "dataset_id string, closure_id string, ref string"))
    assert sorted((r.ref, r.depth) for r in closed.collect()) == [(f"n{i}", i) for i in range(5)]
    assert read.value <= 5 * len(rows)


def test_edges_of_reused_event_ids_are_unique(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    again = t.events.where("seq % 50 = 0").withColumn("ts", F.col("ts") + 1)
    t.__dict__["events"] = t.events.unionByName(again)
    none = spark.createDataFrame([], "dataset_id string, alert_id string, evidence string")
    order = evidence.dependency_edges(t, none).where("rule_family = 'order'")
    assert order.count() == order.select("dataset_id", "src_ref", "dst_ref", "relation_kind").distinct().count() > 0


def test_windows_of_records_are_listed_within_a_task(spark, monkeypatch):
    """Short traces make no rows of pairs, long ones go by time cells; both against comparing all, with ties, no reason, an id twice and records without windows."""
    from tracefold.operators import lineage

    rng = random.Random(12)
    span = lambda: (b := rng.randrange(300), b + rng.choice([0, 0, 3, 40, 200]))
    recs = [(d, f"o{i % 50}", *span()) for d in "ab" for i in range(51)] + [("a", "far", 900, 901), ("c", "alone", 1, 2), ("a", "open", 5, None)]
    wins = [(d, *span(), f"w{i}", rng.choice([None, "X", "Y"])) for d in "abd" for i in range(30)]
    rec = spark.createDataFrame(recs, "dataset_id string, object_id string, t_begin long, t_end long")
    windows = spark.createDataFrame(wins, "dataset_id string, t_begin long, t_end long, window_id string, reason_code string")
    met = {}
    for d, o, b, e in recs:
        met.setdefault((d, o), []).extend((*w[1:4], w[4]) for w in wins if e is not None and w[0] == d and w[1] <= e and b <= w[2])
    want = {k: ([w[2] for w in sorted(v, key=lambda w: w[:3])], sorted({w[3] for w in v} - {None})) for k, v in met.items() if v}
    told = lineage.touching_windows(rec, windows)
    assert "explode" not in told._jdf.queryExecution().toString()
    for limit in (10_000_000, 0):
        monkeypatch.setattr(lineage, "SHORT_TRACE", limit)
        assert {(r.dataset_id, r.object_id): (r.window_ids, r.reasons) for r in lineage.touching_windows(rec, windows).collect()} == want
        assert {(r.dataset_id, r.object_id): (r.n, r.reasons) for r in lineage.touching_windows(rec, windows, counted=True).collect()} == {k: (len(a), b) for k, (a, b) in want.items()}


def test_terms_are_counted_within_their_chunk(spark):
    """Totals equal those of chunks and terms, also of documents that share an id; without such, nothing is dealt by chunk."""
    from tracefold.operators import retrieval

    texts = ["aa bb aa", "\n".join(f"w{i} aa 中文字" for i in range(70)), None, "", "中 bb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "hashpartitioning(doc_id" not in retrieval.term_totals(docs)._jdf.queryExecution().executedPlan().toString()
    for d in (docs, docs.unionByName(docs.where("doc_id in (1, 4)")).unionByName(docs.selectExpr("null as doc_id", "text"))):
        want = retrieval.tokens(retrieval.doc_chunks(d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
        assert {tuple(r) for r in retrieval.term_totals(d).select("term", "df", "tf").collect()} == {tuple(r) for r in want.collect()}


def test_small_ranges_share_a_partition(monkeypatch):
    """Tasks don't grow with files or with a small split; every range is kept, in order, and big ones stay alone."""
    few = segments.SegmentReader("p", "events", 4096)
    monkeypatch.setattr(segments, "found", lambda path: [(f"f{i}", 9000) for i in range(5000)])
    monkeypatch.setattr(few, "ranges", lambda f: [(*f, 0, 4500, 0), (*f, 4500, None, 9)])
    parts = [p.value for p in few.partitions()]
    assert len(parts) <= 2 * segments.PARTITIONS and sum(parts, []) == [r for i in range(5000) for r in few.ranges((f"f{i}", 9000))]
    big = segments.SegmentReader("p", "events", segments.SPLIT_BYTES)
    monkeypatch.setattr(segments, "found", lambda path: [(f"f{i}", segments.SPLIT_BYTES) for i in range(1000)])
    assert len(big.partitions()) == 1000


def test_kept_tables_read_the_trace_once(spark):
    """Raw events are written before they are read again, and metrics group each table once."""
    from tracefold.operators import metrics

    t = tables(spark, "/root/testdata/sf0.001", keep=True)
    assert "Window" not in t.raw._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.metric_values(t, t.scope)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 12
