"""Hand-written traces with the intervals that the rules give."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.functions import scans
from tracefold.operators import integrity, rebuild
from tracefold.plans.trace import TraceTables

COLUMNS = "dataset_id core_id seq ts_raw event_name task_id obj_id prev_task_id next_task_id wait_obj_id owner_task_id irq_id nesting_depth reason prio deadline_ts job_id lost_count overflow_count".split()
SCHEMA = ", ".join(f"{c} {'string' if c in ('dataset_id', 'event_name') else 'int' if c in ('core_id', 'nesting_depth') else 'long'}" for c in COLUMNS)


def events(spark, rows):
    full = [tuple({"dataset_id": "d", "core_id": 0, "seq": i + 1, **r}.get(c) for c in COLUMNS) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("event_uid", F.concat_ws(":", F.lit("evt"), "dataset_id", "core_id", "seq"))


def e(ts, name, **more):
    return {"ts_raw": ts, "event_name": name, **more}


def switch(ts, prev, nxt, **more):
    return e(ts, "CTX_SWITCH", prev_task_id=prev, next_task_id=nxt, task_id=nxt, **more)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        e(0, "TASK_READY", task_id=2), e(1, "TASK_READY", task_id=1), switch(3, 0, 1), e(4, "SYNC_LOCK", task_id=2, obj_id=100), e(8, "IRQ_ENTER", irq_id=7, nesting_depth=1),
        e(10, "IRQ_EXIT", irq_id=7, nesting_depth=1), e(13, "TASK_BLOCK", task_id=1, obj_id=100, wait_obj_id=100, owner_task_id=2), switch(13, 1, 2),
        e(20, "SYNC_UNLOCK", task_id=2, obj_id=100), e(20, "TASK_WAKEUP", task_id=1, obj_id=100), switch(22, 2, 1), e(30, "TASK_EXIT", task_id=1),
    ]
    return TraceTables(events(spark, rows))


def test_slices(sample):
    assert sorted((r.task_id, r.t_begin, r.t_end) for r in sample.slices.collect()) == [(1, 3, 13), (1, 22, 30), (2, 13, 22)]


def test_states(sample):
    got = sorted((r.task_id, r.t_begin, r.t_end, r.state) for r in sample.states.collect())
    assert got == [
        (1, 1, 3, "READY"), (1, 3, 13, "RUNNING"), (1, 13, 20, "BLOCKED"), (1, 20, 22, "READY"), (1, 22, 30, "RUNNING"), (1, 30, 30, "EXIT"),
        (2, 0, 13, "READY"), (2, 13, 22, "RUNNING"), (2, 22, 30, "READY"),
    ]


def test_edges_and_irqs(sample):
    assert [(r.task_id, r.obj_id, r.t_begin, r.t_end, r.close_kind) for r in sample.holds.collect()] == [(2, 100, 4, 20, "NORMAL")]
    assert [(r.task_id, r.obj_id, r.t_begin, r.t_end, r.owner_task_id) for r in sample.waits.collect()] == [(1, 100, 13, 20, 2)]
    assert [(r.irq_id, r.t_begin, r.t_end, r.delayed_task) for r in sample.irqs.collect()] == [(7, 8, 10, 1)]


def test_hold_bounds(spark):
    rows = [
        e(100, "SYNC_LOCK", task_id=1, obj_id=1), e(125, "SYNC_LOCK", task_id=1, obj_id=1), e(150, "SYNC_LOCK", task_id=2, obj_id=1), e(180, "SYNC_UNLOCK", task_id=1, obj_id=1),
        e(190, "SYNC_UNLOCK", task_id=1, obj_id=1), e(250, "TASK_EXIT", task_id=2), e(300, "SYNC_LOCK", task_id=3, obj_id=9), e(400, "TASK_READY", task_id=5),
    ]
    got = sorted((r.task_id, r.t_begin, r.t_end, r.close_kind) for r in TraceTables(events(spark, rows)).holds.collect())
    assert got == [(1, 100, 125, "SUCCESSOR_OPEN"), (1, 125, 180, "NORMAL"), (1, 190, 190, "UNMATCHED"), (2, 150, 250, "TERMINAL_TASK_EXIT"), (3, 300, 400, "OPEN")]


def test_sequence_gap(spark):
    raw = events(spark, [e(5, "TASK_READY", task_id=1), {**e(9, "TASK_READY", task_id=1), "seq": 3}])
    assert [(r.t_begin, r.t_end, r.reason_code) for r in integrity.seq_gap_windows(raw).collect()] == [(5, 9, "SEQ_GAP")]


def test_alignment_needs_every_core_anchored(spark):
    rows = [e(100, "SYNC_CALIB"), e(200, "TASK_READY", task_id=1), {**e(110, "TS_CALIB"), "core_id": 1, "seq": 1}, {**e(90, "TASK_READY", task_id=2), "core_id": 1, "seq": 2}, {**e(210, "TASK_READY", task_id=2), "core_id": 1, "seq": 3}]
    t = TraceTables(events(spark, rows))
    assert sorted((r.core_id, r.ts_raw, r.ts, r.covered) for r in t.events.collect()) == [(0, 100, 100, True), (0, 200, 200, True), (1, 90, 90, False), (1, 110, 100, True), (1, 210, 200, True)]
    half = TraceTables(events(spark, rows[:2] + rows[3:]))
    assert {r.covered for r in half.events.collect()} == {False}


def walk_states(rows):
    """The rule read literally, one event after another."""
    state, out = {}, []

    def go(task, new, ts):
        if task in state:
            out.append((task, state[task][0], state[task][1], ts))
        state[task] = (new, ts)

    for r in rows:
        n, ts = r["event_name"], r["ts_raw"]
        if n == "CTX_SWITCH":
            if r["prev_task_id"] and state.get(r["prev_task_id"], ("",))[0] == "RUNNING":
                go(r["prev_task_id"], "READY", ts)
            if r["next_task_id"]:
                go(r["next_task_id"], "RUNNING", ts)
        else:
            go(r["task_id"], {"TASK_READY": "READY", "TASK_WAKEUP": "READY", "TASK_BLOCK": "BLOCKED", "TASK_EXIT": "EXIT"}[n], ts)
    end = rows[-1]["ts_raw"]
    return sorted(out + [(t, s, b, end) for t, (s, b) in state.items()])


def test_states_match_a_sequential_walk(spark):
    rng = random.Random(3)
    rows = []
    for ts in range(400):
        name = rng.choice(["TASK_READY", "TASK_BLOCK", "TASK_WAKEUP", "TASK_EXIT", "CTX_SWITCH", "CTX_SWITCH"])
        rows.append(switch(ts, rng.randrange(4), rng.randrange(4)) if name == "CTX_SWITCH" else e(ts, name, task_id=rng.randrange(1, 4)))
    got = sorted((r.task_id, r.state, r.t_begin, r.t_end) for r in TraceTables(events(spark, rows)).states.collect())
    assert got == walk_states(rows)


def walk_irqs(rows):
    """(begin, end, kind) per core by a stack, row for row."""
    out = []
    for core in {r.get("core_id", 0) for r in rows}:
        stack = []
        for r in (r for r in rows if r.get("core_id", 0) == core):
            key = (r["irq_id"], r["nesting_depth"])
            if r["event_name"] == "IRQ_ENTER":
                stack.append((key, r["ts_raw"]))
            elif stack and stack[-1][0] == key:
                out.append((core, stack.pop()[1], r["ts_raw"], "NORMAL"))
            else:
                out.append((core, r["ts_raw"], r["ts_raw"], "UNMATCHED"))
        out += [(core, ts, rows[-1]["ts_raw"], "OPEN") for _, ts in stack]
    return sorted(out)


def irq_rows(rng, shape, n):
    irq = lambda ts, enter, irq_id, depth, core=0: e(ts, "IRQ_ENTER" if enter else "IRQ_EXIT", core_id=core, irq_id=irq_id, nesting_depth=depth)
    if shape == "random":
        return [irq(ts, rng.random() < 0.5, rng.randrange(2), rng.randrange(1, 3), rng.randrange(2)) for ts in range(n)]
    if shape == "exits":  # long runs of exits, with and without an enter below
        return [irq(ts, ts % 40 == 20, 1, ts % 7) for ts in range(n)]
    if shape == "deep":  # one stack of n / 2 levels
        return [irq(i, True, i % 3, i) for i in range(n // 2)] + [irq(n - 1 - i, False, i % 3, i) for i in range(n // 2 - 1, -1, -1)]
    rows, stack = [], []  # nested, with some enters and exits lost or altered
    while len(rows) < n:
        if not stack or rng.random() < 0.5 and len(stack) < 30:
            stack.append((rng.randrange(4), len(stack) + 1))
            made = (True, *stack[-1])
        else:
            made = (False, *stack.pop())
        if rng.random() > 0.06:
            rows.append(irq(len(rows), made[0], made[1] if rng.random() > 0.03 else 9, made[2]))
    return rows


@pytest.mark.parametrize("long", [False, True])
@pytest.mark.parametrize("shape", ["random", "exits", "deep", "nested"])
def test_irq_stack_matches_a_walk(spark, shape, long):
    rows = irq_rows(random.Random(5), shape, 300)
    told = rebuild.irq_spans(TraceTables(events(spark, rows), long=long).events, long)
    got = sorted((r.core_id, r.t_begin, r.t_end, r.close_kind) for r in told.collect())
    assert got == walk_irqs(rows)


def test_long_traces_give_the_same_rows(spark, monkeypatch):
    """All interval tables of one trace by cells equal those by windows."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        name = rng.choice(["TASK_READY", "TASK_BLOCK", "TASK_WAKEUP", "TASK_EXIT", "TASK_DISPATCH", "CTX_SWITCH", "SYNC_LOCK", "SYNC_UNLOCK", "IRQ_ENTER", "IRQ_EXIT", "LOSS", "OVERFLOW", "TS_CALIB"])
        ts = i if rng.random() < 0.98 else i + 10**12  # a few far outliers
        core = rng.randrange(2)
        if name == "CTX_SWITCH":
            row = switch(ts, rng.randrange(4), rng.randrange(4), core_id=core)
        else:
            obj = rng.choice([None, 1, 2])
            row = e(ts, name, core_id=core, task_id=rng.randrange(1, 4), obj_id=obj, wait_obj_id=obj if name == "TASK_BLOCK" else None, irq_id=rng.randrange(2), nesting_depth=1, reason=rng.randrange(4))
        rows.append(row)
    frame = events(spark, rows)
    short, long = TraceTables(frame, long=False), TraceTables(frame, long=True)
    assert short.events.count() == 1500
    for name in ("events", "states", "slices", "holds", "waits", "irqs", "windows"):
        a, b = getattr(short, name), getattr(long, name)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect())), name
    monkeypatch.setattr(scans, "LONG_KEY", 100)
    assert TraceTables(frame).is_long and not scans.is_long(frame.limit(50), ["dataset_id"])


def test_scan_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([None, 1, 5])) for t in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    ask = dict(lag={"before": F.col("v")}, lead={"after": F.col("v")}, last={"seen": F.col("v")}, total={"sum": F.col("v")}, highest={"top": F.col("v")}, number="n")
    results = [sorted(map(str, scans.scan(df, ["k"], ["t"], **ask, long=long, cells=9).collect())) for long in (False, True)]
    assert results[0] == results[1]
