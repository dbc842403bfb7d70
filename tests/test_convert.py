"""Kernel trace lines and cluster records to events, against walks that take one line after another."""

import hashlib
import random
import re

import pytest

from tracefold.functions import scans
from tracefold.operators import convert

NEVER = 9_223_372_036_854_775_807


def object_id(call, task):
    return int(hashlib.md5(f"{call}:{task}".encode()).hexdigest()[:15], 16)


def walk_lines(lines):
    """(core, seq, time, name, task, prev, next, irq, depth, reason, object, type, wake source) of (time, cpu, tid, text) lines."""
    depth, active, blocked, seq, out = {}, {}, {}, {}, []

    def emit(core, ts, name, **v):
        seq[core] = seq.get(core, 0) + 1
        out.append((core, seq[core], ts, name, *(v.get(f) for f in ("task", "prev", "next", "irq", "depth", "reason", "obj", "type", "wake"))))

    kind = lambda call: 1 if "mutex" in call else 2 if "sem" in call else 3 if re.search("mq_|queue|msgq", call) else 4 if re.search("event|flag", call) else 2
    why = lambda call: 1 if re.search("sleep|delay", call) else {1: 3, 2: 4, 3: 5, 4: 6}[kind(call)] if re.search("mutex|sem|mq_|queue|msgq|event|flag", call) else 2
    for ts, cpu, tid, text in sorted(lines):
        if m := re.match(r"sched_wakeup_new: comm=\S+ pid=(\d+) target_cpu=(\d+)", text):
            emit(int(m[2]), ts, "TASK_READY", task=int(m[1]), reason=1)
        elif m := re.match(r"sched_(?:waking|wakeup): comm=\S+ pid=(\d+) target_cpu=(\d+)", text):
            reason, obj = blocked.get(int(m[1]), (2, 0))
            emit(int(m[2]), ts, "TASK_WAKEUP", task=int(m[1]), obj=obj, wake=4 if depth.get(cpu, 0) else {1: 2, 2: 3}.get(reason, 1))
        elif m := re.match(r"sched_switch: prev_comm=\S+ prev_pid=(\d+) prev_state=(\S+) ==> next_comm=\S+ next_pid=(\d+)", text):
            prev, nxt, sleeps = int(m[1]), int(m[3]), re.search("[SDT]", m[2])
            reason = 5 if depth.get(cpu, 0) else 3 if sleeps else 1
            if prev and sleeps:
                call = active.get(prev)
                blocked[prev] = (why(call[0]) if call else 2, call[1] if call else 0)
                emit(cpu, ts, "TASK_BLOCK", task=prev, reason=blocked[prev][0], obj=blocked[prev][1])
            if nxt:
                emit(cpu, ts, "TASK_DISPATCH", task=nxt, reason=reason)
            emit(cpu, ts, "CTX_SWITCH", task=nxt, prev=prev, next=nxt, reason=reason)
        elif m := re.match(r"irq_handler_entry: irq=(\d+)", text):
            depth[cpu] = depth.get(cpu, 0) + 1
            emit(cpu, ts, "IRQ_ENTER", irq=int(m[1]), depth=depth[cpu])
        elif m := re.match(r"irq_handler_exit: irq=(\d+)", text):
            now = max(depth.get(cpu, 0), 1)
            emit(cpu, ts, "IRQ_EXIT", irq=int(m[1]), depth=now)
            depth[cpu] = now - 1
        elif m := re.match(r"sys_(\w+)\(.*\)$", text):
            active[tid] = (m[1], object_id(m[1], tid))
            if re.search("sem_|mutex_|mq_|queue|msgq|event|flag", m[1]):
                emit(cpu, ts, "SYNC_TRY", task=tid, obj=active[tid][1], type=kind(m[1]))
        elif m := re.match(r"sys_(\w+)\s*->\s*(.+)$", text):
            held = active.pop(tid, None)
            obj, good = held[1] if held else object_id(m[1], tid), not m[2].startswith("-")
            if good and re.search("sem_wait|sem_timedwait|mutex_lock|mutex_timedlock|mq_receive|mq_timedreceive|event_wait|flag_wait", m[1]):
                emit(cpu, ts, "SYNC_LOCK", task=tid, obj=obj, type=kind(m[1]))
            elif good and re.search("sem_post|mutex_unlock|mq_send|mq_timedsend|event_post|flag_post", m[1]):
                emit(cpu, ts, "SYNC_UNLOCK", task=tid, obj=obj, type=kind(m[1]))
    return out


@pytest.mark.parametrize("long", [False, True])
def test_trace_lines(spark, long):
    rng = random.Random(3)
    calls = "sem_wait sem_post mutex_lock mutex_unlock nanosleep mq_send mq_receive event_wait flag_post read".split()
    lines = []
    for i in range(700):
        cpu, tid, other = rng.randrange(3), rng.randrange(1, 6), rng.randrange(6)
        text = rng.choice([
            f"sched_wakeup_new: comm=x pid={other} target_cpu={rng.randrange(3)}", f"sched_waking: comm=x pid={other} target_cpu={rng.randrange(3)}", f"sched_wakeup: comm=x pid={other} target_cpu={rng.randrange(3)}",
            f"sched_switch: prev_comm=a prev_pid={other} prev_state={rng.choice(['S', 'R', 'D|K', 'T', 'R+'])} ==> next_comm=b next_pid={rng.randrange(6)}", f"irq_handler_entry: irq={rng.randrange(4)} name=z", f"irq_handler_exit: irq={rng.randrange(4)} ret=handled",
            f"sys_{rng.choice(calls)}(a, {i})", f"sys_{rng.choice(calls)} -> {rng.choice(['0', '-11', '5'])}", f"sys_{rng.choice(calls)}()", "some other line",
        ])
        lines.append((1000 * (i // 3), cpu, tid, text))
    frame = spark.createDataFrame([(f"t{tid}", tid, cpu, ts, text) for ts, cpu, tid, text in lines], "task_name string, tid long, cpu int, timestamp_ns long, payload string").repartition(3)
    got = convert.systrace_to_events(frame, long)
    columns = "core_id seq ts_raw event_name task_id prev_task_id next_task_id irq_id nesting_depth reason obj_id obj_type wake_src".split()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, walk_lines(lines)))


def walk_records(records, buckets):
    """(core, seq, time, name, task, prio, hint, reason, object, prev, next, exit code, wake source) of (collection, instance, machine, type, priority, time) records in order."""
    tasks, cores, running, where, latest, seq, out, seen = {}, {}, {}, {}, 0, {}, [], set()

    def emit(core, ts, name, **v):
        seq[core] = seq.get(core, 0) + 1
        out.append((core, seq[core], ts, name, *(v.get(f) for f in ("task", "prio", "hint", "reason", "obj", "prev", "next", "code", "wake"))))

    def leave(task, ts, reason):
        core = where.pop(task, None)
        if core is not None and running.get(core) == task:
            emit(core, ts, "CTX_SWITCH", task=0, prev=task, next=0, reason=reason)
            del running[core]

    for collection, instance, machine, kind, priority, time in records:
        task = tasks.setdefault((collection, instance), len(tasks) + 1)
        ts = latest + 1 if time >= NEVER else time
        latest = max(latest, ts)
        core = 0 if not machine else 1 + abs(machine) % buckets if buckets else cores.setdefault(machine, len(cores) + 1)
        prio, first = max(-32768, min(32767, priority or 0)), task not in seen
        seen.add(task)
        if kind == 0:
            emit(0, ts, "TASK_READY", task=task, prio=prio, hint=core, reason=1 if first else 2)
        elif kind == 1:
            leave(task, ts, 3)
            emit(0, ts, "SYNC_TRY", task=task, obj=collection)
            emit(0, ts, "TASK_BLOCK", task=task, obj=collection, reason=5)
        elif kind == 2:
            emit(0, ts, "TASK_WAKEUP", task=task, obj=collection, wake=3)
        elif kind == 3:
            target = core or where.get(task, 0) or 1
            if task in where and where[task] != target:
                leave(task, ts, 2)
            before = running.get(target, 0)
            emit(target, ts, "TASK_DISPATCH", task=task, prio=prio, reason=1)
            if before != task:
                emit(target, ts, "CTX_SWITCH", task=task, prev=before, next=task, reason=2 if before else 1)
            running[target], where[task] = task, target
        elif kind == 4:
            leave(task, ts, 3)
            emit(0, ts, "TASK_BLOCK", task=task, obj=collection, reason=2)
        elif kind in (5, 6, 7, 8):
            leave(task, ts, 6)
            emit(core, ts, "TASK_EXIT", task=task, code={5: 1, 6: 0, 7: 137, 8: 2}[kind])
        elif kind == 9:
            emit(0, ts, "TASK_READY", task=task, prio=prio, hint=core, reason=2)
        elif kind == 10:
            emit(where.get(task, core) or 1, ts, "TASK_DISPATCH", task=task, prio=prio, reason=1)
    return out


@pytest.mark.parametrize(("buckets", "long"), [(None, False), (3, False), (None, True)])
def test_cluster_records(spark, buckets, long):
    rng = random.Random(9)
    records = [(rng.randrange(1, 5), rng.randrange(3), rng.choice([None, 0, -7, 4, 11, 900]), rng.choice([0, 1, 2, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 10, 99]), rng.choice([None, 5, 10**6, -(10**6)]), NEVER if rng.random() < 0.01 else 10 * i) for i in range(700)]
    records.sort(key=lambda r: (r[5], r[0], r[1], r[3], r[2] is not None and r[2] != 0, r[2] or 0))
    frame = spark.createDataFrame(records, "collection_id long, instance_index int, machine_id long, type int, priority int, time long").repartition(3)
    got = convert.cluster_to_events(frame, buckets, long)
    columns = "core_id seq ts_raw event_name task_id prio core_hint reason obj_id prev_task_id next_task_id exit_code wake_src".split()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, walk_records(records, buckets)))


def test_short_tasks_of_many_cluster_records_are_not_scanned_by_cells(spark, monkeypatch):
    """Only what is long is dealt by ranges: the records and the queue's events, not the tasks, machines and cores."""
    rng = random.Random(4)
    records = [(rng.randrange(100), rng.randrange(3), rng.randrange(50), rng.randrange(11), 0, NEVER if i % 97 == 0 else 10 * i) for i in range(600)]
    frame = spark.createDataFrame(records, "collection_id long, instance_index int, machine_id long, type int, priority int, time long")
    plain = sorted(map(str, convert.cluster_to_events(frame, None, False).collect()))
    dealt, deal = [], type(frame).repartitionByRange
    monkeypatch.setattr(type(frame), "repartitionByRange", lambda self, *a: dealt.append(a) or deal(self, *a))
    monkeypatch.setattr(convert, "LONG_KEY", 400)
    monkeypatch.setattr(scans, "LONG_KEY", 400)
    assert sorted(map(str, convert.cluster_to_events(frame).collect())) == plain
    assert len(dealt) == 2
