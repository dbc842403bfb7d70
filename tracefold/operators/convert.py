"""Foreign rows to canonical scheduler events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import LONG_KEY, is_long, scan
from ..functions.tables import settle

#: Largest time of the cluster format: "after the end".
NEVER = 9_223_372_036_854_775_807
TERMINAL = (5, 6, 7, 8)  # fail, finish, kill, lost


def btf_to_semantic(rows: DataFrame) -> DataFrame:
    """task_create, context_switch or marker, with the cpu from Core_n."""
    kind = F.when(F.col("detail") == "create", "task_create").when(F.col("kind") == "T", "context_switch").otherwise("marker")
    return rows.select("timestamp", kind.alias("semantic"), F.regexp_extract("subject", r"^Core_(\d+)$", 1).try_cast("int").alias("cpu"), "target", "action")


def vcd_to_semantic(changes: DataFrame) -> DataFrame:
    return changes.select("timestamp", F.lit("marker").alias("semantic"), "identifier", "value")


#: The lines that carry events, and what their system calls act on.
CALLS = {
    "ready": r"^sched_wakeup_new: comm=(\S+) pid=(\d+) target_cpu=(\d+)",
    "wake": r"^sched_(?:waking|wakeup): comm=(\S+) pid=(\d+) target_cpu=(\d+)",
    "switch": r"^sched_switch: prev_comm=(\S+) prev_pid=(\d+) prev_state=(\S+) ==> next_comm=(\S+) next_pid=(\d+)",
    "irq_in": r"^irq_handler_entry: irq=(\d+)",
    "irq_out": r"^irq_handler_exit: irq=(\d+)",
    "enter": r"^sys_([A-Za-z0-9_]+)\((.*)\)$",
    "leave": r"^sys_([A-Za-z0-9_]+)\s*->\s*(.+)$",
}
SYNC_CALL = "sem_|mutex_|mq_|queue|msgq|event|flag"
LOCK_CALL = "sem_wait|sem_timedwait|mutex_lock|mutex_timedlock|mq_receive|mq_timedreceive|event_wait|flag_wait"
UNLOCK_CALL = "sem_post|mutex_unlock|mq_send|mq_timedsend|event_post|flag_post"
#: The first pattern that a call's name has gives the type of its object, and the reason of a block in it; others have 2.
OBJECT_TYPES = (("mutex", 1), ("sem", 2), ("mq_|queue|msgq", 3), ("event|flag", 4))
BLOCK_REASONS = (("sleep|delay", 1), ("mutex", 3), ("sem", 4), ("mq_|queue|msgq", 5), ("event|flag", 6))


def _first_match(name: Column, table: tuple) -> Column:
    out = F.lit(2)
    for pattern, value in reversed(table):
        out = F.when(name.rlike(pattern), value).otherwise(out)
    return out


def object_id(call: Column, task: Column) -> Column:
    """A number of 60 bits that stays the same for a call of a task (from the MD5 of both)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", call, task.cast("string"))), 1, 15), 16, 10).cast("long")


def systrace_to_events(lines: DataFrame, long: bool | None = None) -> DataFrame:
    """dataset_id, core_id, seq, ts_raw, event_name, task_id, prev_task_id, next_task_id, irq_id, nesting_depth, reason, obj_id, obj_type, wake_src.

    Lines count in order of time (then core, task and text). Three states are
    carried along: the interrupt depth of a core (a walk that never falls below
    zero: the running sum less its lowest value so far), the system call that a
    task is in, and the call that it was last blocked in, which a wakeup on any
    core reports. A switch gives a block (if the previous task sleeps), a
    dispatch and itself; calls on objects give a try when they begin and a lock
    or unlock when they end well.
    """
    part = lambda kind, i: F.regexp_extract("payload", CALLS[kind], i)
    kind = F.coalesce(*[F.when(F.col("payload").rlike(p), k) for k, p in CALLS.items()])
    trace = F.col("dataset_id") if "dataset_id" in lines.columns else F.lit("0")
    rows = lines.select(trace.alias("dataset_id"), "timestamp_ns", "cpu", "tid", "payload", kind.alias("kind")).where("kind is not null")
    is_ = lambda *names: F.col("kind").isin(*names)
    pid = F.when(is_("ready"), part("ready", 2)).when(is_("wake"), part("wake", 2)).when(is_("switch"), part("switch", 2)).try_cast("long")
    target = F.when(is_("ready"), part("ready", 3)).when(is_("wake"), part("wake", 3)).try_cast("int")
    call = F.lower(F.when(is_("enter"), part("enter", 1)).otherwise(part("leave", 1)))
    rows = rows.withColumns(
        {
            "subject": F.when(is_("enter", "leave"), F.col("tid")).otherwise(pid), "core_id": F.coalesce(target, F.col("cpu")), "call": F.when(is_("enter", "leave"), call), "next": F.when(is_("switch"), part("switch", 5).try_cast("long")),
            "sleeps": is_("switch") & part("switch", 3).rlike("[SDT]") & (pid > 0), "irq_id": F.when(is_("irq_in"), part("irq_in", 1)).when(is_("irq_out"), part("irq_out", 1)).try_cast("long"), "done": is_("leave") & ~part("leave", 2).startswith("-"),
        }
    )
    order = ["timestamp_ns", "cpu", "tid", "payload", "copy"]
    # lines that are alike in all else are told apart by their place
    rows = settle(rows.withColumn("copy", F.monotonically_increasing_id()))
    long = is_long(rows, ["dataset_id"]) if long is None else long
    step = F.when(is_("irq_in"), 1).when(is_("irq_out"), -1).otherwise(0)
    rows = scan(rows, ["dataset_id", "cpu"], order, total={"walk": step}, long=long)
    rows = scan(rows, ["dataset_id", "cpu"], order, highest={"high": -F.col("walk")}, long=long)
    rows = rows.withColumn("level", F.col("walk") - F.least(F.lit(0), F.col("walk"), -F.col("high")))

    own = F.struct("call", object_id(F.col("call"), F.col("subject")).alias("obj"))
    of_task = scan(rows.where("subject is not null"), ["dataset_id", "subject"], order, last={"active": F.when(is_("enter"), F.struct(F.lit(True).alias("inside"), own.alias("own"))).when(is_("leave"), F.struct(F.lit(False).alias("inside"), own.alias("own")))}, long=long)
    inside = F.when(F.col("active.inside"), F.col("active.own"))
    blocked = F.when(F.col("sleeps"), F.struct(F.coalesce(_first_match(inside["call"], BLOCK_REASONS), F.lit(2)).alias("reason"), F.coalesce(inside["obj"], F.lit(0).cast("long")).alias("obj")))
    of_task = scan(of_task, ["dataset_id", "subject"], order, lag={"before": F.col("active")}, last={"block": blocked}, long=long)
    rest = rows.where("subject is null")
    none = lambda name: F.lit(None).cast(of_task.schema[name].dataType).alias(name)
    rows = of_task.unionByName(rest.select("*", none("active"), none("before"), none("block")))

    irq = F.col("level") > 0
    dispatch = F.when(irq, 5).when(part("switch", 3).rlike("[SDT]"), 3).otherwise(1)
    reason, obj = F.coalesce("block.reason", F.lit(2)), F.coalesce("block.obj", F.lit(0).cast("long"))
    wake = F.when(irq, 4).when(reason == 1, 2).when(reason == 2, 3).otherwise(1)
    held = F.coalesce(F.when(F.col("before.inside"), F.col("before.own.obj")), own["obj"])
    kind_of = _first_match(F.col("call"), OBJECT_TYPES)
    fields = {"task_id": "long", "prev_task_id": "long", "next_task_id": "long", "reason": "int", "obj_id": "long", "obj_type": "int", "wake_src": "int"}
    e = lambda name, sub, **v: F.struct(F.lit(name).alias("event_name"), F.lit(sub).alias("sub"), *[v.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()])
    task, nxt = F.col("subject"), F.col("next")
    events = (
        F.when(is_("ready"), F.array(e("TASK_READY", 0, task_id=task, reason=F.lit(1))))
        .when(is_("wake"), F.array(e("TASK_WAKEUP", 0, task_id=task, wake_src=wake, obj_id=obj)))
        .when(
            is_("switch"),
            F.array(
                F.when(F.col("sleeps"), e("TASK_BLOCK", 0, task_id=task, reason=reason, obj_id=obj)),
                F.when(nxt > 0, e("TASK_DISPATCH", 1, task_id=nxt, reason=dispatch)),
                e("CTX_SWITCH", 2, task_id=nxt, prev_task_id=task, next_task_id=nxt, reason=dispatch),
            ),
        )
        .when(is_("irq_in"), F.array(e("IRQ_ENTER", 0)))
        .when(is_("irq_out"), F.array(e("IRQ_EXIT", 0)))
        .when(is_("enter") & F.col("call").rlike(SYNC_CALL), F.array(e("SYNC_TRY", 0, task_id=task, obj_id=own["obj"], obj_type=kind_of)))
        .when(F.col("done") & F.col("call").rlike(LOCK_CALL), F.array(e("SYNC_LOCK", 0, task_id=task, obj_id=held, obj_type=kind_of)))
        .when(F.col("done") & F.col("call").rlike(UNLOCK_CALL), F.array(e("SYNC_UNLOCK", 0, task_id=task, obj_id=held, obj_type=kind_of)))
    )
    depth = F.when(is_("irq_in"), F.col("level")).when(is_("irq_out"), F.col("level") + 1)
    out = rows.select("dataset_id", "core_id", *order, "irq_id", depth.cast("int").alias("nesting_depth"), F.explode(F.array_compact(events)).alias("x")).select("dataset_id", "core_id", *order, "irq_id", "nesting_depth", "x.*")
    out = scan(out, ["dataset_id", "core_id"], [*order, "sub"], number="seq", long=long)
    return out.select("dataset_id", "core_id", F.col("seq").cast("long").alias("seq"), F.col("timestamp_ns").alias("ts_raw"), "event_name", "task_id", "prev_task_id", "next_task_id", "irq_id", "nesting_depth", "reason", "obj_id", "obj_type", "wake_src")


def _numbered_by_first(rows: DataFrame, keys: list[str], name: str, long: bool | None) -> DataFrame:
    """The values of ``keys`` with numbers from 1 in order of their first place, that place (as <name>_first) and their rows (as <name>_rows)."""
    firsts = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("place").alias(f"{name}_first"), F.count("*").alias(f"{name}_rows"))
    return settle(scan(settle(firsts), [], [f"{name}_first"], number=name, long=long))


def cluster_to_events(rows: DataFrame, buckets: int | None = None, long: bool | None = None) -> DataFrame:
    """Instance events of a cluster as scheduler events: core_id, seq, ts_raw, event_name, task_id, prio, core_hint, reason, obj_id, prev_task_id, next_task_id, exit_code, wake_src.

    Records count in order of time (then collection, instance, type and
    machine). Tasks (collection, instance) and machines are numbered by first
    appearance; with ``buckets`` a machine is core 1 + |id| mod buckets. Core 0
    is the queue. A time of "never" is one more than the latest before it.

    Two states run through each other. A task's run begins when it is
    scheduled and ends when it is queued, evicted or done; within it, it holds
    the core of its last schedule (a schedule without a machine stays there,
    or goes to core 1). A core holds the task that was last scheduled on it. A
    task that leaves a core gives a switch to idle if the core still holds it;
    one that comes gives a switch from the core's task unless that is itself.
    """
    order = ["time", "collection_id", "instance_index", "type", "machine_id", "copy"]
    r = settle(rows.select("collection_id", "instance_index", F.nullif("machine_id", F.lit(0)).alias("machine_id"), "type", F.coalesce("priority", F.lit(0)).alias("priority"), "time").where("collection_id is not null and instance_index is not null").withColumn("copy", F.monotonically_increasing_id()))
    many = r.count() > LONG_KEY if long is None else long
    # times of "never" are the last ones, so their number is their place behind all others
    never = F.col("time") >= NEVER
    ends = r.agg(F.max(F.when(~never, F.col("time"))).alias("latest"), F.sum(F.when(never, 0).otherwise(1)).alias("others"))
    r = scan(r, [], order, number="place", long=many).crossJoin(F.broadcast(ends))
    r = r.withColumn("ts_raw", F.when(never, F.greatest(F.coalesce("latest", F.lit(0).cast("long")), F.lit(0)) + F.col("place") - F.col("others")).otherwise(F.col("time"))).drop("time", "copy", "latest", "others")
    if buckets:
        machine = 1 + F.pmod(F.abs("machine_id"), F.lit(buckets))
    else:
        r, machine = r.join(_numbered_by_first(r, ["machine_id"], "machine", long).drop("machine_first", "machine_rows"), "machine_id", "left"), F.col("machine")
    r = r.withColumn("machine", F.coalesce(machine, F.lit(0)).cast("int")).drop("machine_id")
    task = ["collection_id", "instance_index"]
    tasks = _numbered_by_first(r, task, "task_id", long)
    of_task = tasks.agg(F.max("task_id_rows").alias("n")).first()["n"] or 0
    of_task = of_task > LONG_KEY if long is None else long
    r = r.join(tasks.drop("task_id_rows"), task)
    kind = F.col("type")
    come, leave = kind == 3, kind.isin(1, 4, *TERMINAL)
    # by collection and instance, as the join has dealt them
    r = scan(r, task, ["place"], total={"left": leave.cast("int")}, long=of_task).withColumn("run", F.col("left") - leave.cast("int"))
    run = [*task, "run"]
    r = scan(r, run, ["place"], last={"named": F.when(come & (F.col("machine") > 0), F.col("machine"))}, long=of_task)
    r = scan(r, run, ["place"], last={"running": F.when(come, F.coalesce("named", F.lit(1)))}, long=of_task)
    r = settle(scan(r, run, ["place"], lag={"before": F.col("running")}, long=of_task).drop("left", "run", "named"))

    #: The reason of a switch to idle by what made the task leave.
    why = F.when(kind.isin(1, 4), 3).when(come, 2).otherwise(6)
    outs = r.select(F.when(come, F.col("before")).otherwise(F.col("running")).alias("core"), "place", F.lit(0).alias("sub"), "task_id", why.alias("why"), (leave | (come & (F.col("before") != F.col("running")))).alias("goes"), "ts_raw")
    outs = outs.where("goes and core is not null").drop("goes")
    ins = r.where(come).select(F.col("running").alias("core"), "place", F.lit(2).alias("sub"), "task_id", F.lit(None).cast("int").alias("why"), "ts_raw")
    both = outs.unionByName(ins)
    of_core = is_long(both, ["core"]) if long is None else long
    both = scan(both, ["core"], ["place", "sub"], last={"holder": F.when(F.col("sub") == 2, F.col("task_id"))}, long=of_core)
    now = F.when(F.col("sub") == 2, F.col("task_id")).when(F.col("holder") == F.col("task_id"), 0)
    both = scan(both, ["core"], ["place", "sub"], last={"current": now}, long=of_core)
    both = scan(both, ["core"], ["place", "sub"], lag={"held": F.col("current")}, long=of_core).withColumn("held", F.coalesce("held", F.lit(0)))
    fields = {"task_id": "long", "prio": "int", "core_hint": "int", "reason": "int", "obj_id": "long", "prev_task_id": "long", "next_task_id": "long", "exit_code": "int", "wake_src": "int"}
    full = lambda **v: [v.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()]
    task = F.col("task_id")
    switched = both.where("sub = 0 and holder = task_id or sub = 2 and held <> task_id")
    gone = F.col("sub") == 0
    switches = switched.select(
        F.col("core").alias("core_id"), "place", "sub", "ts_raw", F.lit("CTX_SWITCH").alias("event_name"),
        *full(task_id=F.when(gone, 0).otherwise(task), reason=F.when(gone, F.col("why")).when(F.col("held") == 0, 1).otherwise(2), prev_task_id=F.when(gone, task).otherwise(F.col("held")), next_task_id=F.when(gone, 0).otherwise(task)),
    )

    prio = F.least(F.greatest("priority", F.lit(-32768)), F.lit(32767))
    obj = F.col("collection_id").bitwiseAND((1 << 63) - 1)
    queue, here = F.lit(0), F.when(come, F.col("running")).otherwise(F.coalesce("running", F.nullif("machine", F.lit(0)), F.lit(1)))
    e = lambda name, sub, core, **v: F.struct(F.lit(name).alias("event_name"), F.lit(sub).alias("sub"), core.cast("int").alias("core_id"), *full(task_id=task, **v))
    code = F.when(kind == 5, 1).when(kind == 6, 0).when(kind == 7, 137).otherwise(2)
    names = (
        F.when(kind == 0, F.array(e("TASK_READY", 1, queue, prio=prio, core_hint=F.col("machine"), reason=F.when(F.col("place") == F.col("task_id_first"), 1).otherwise(2))))
        .when(kind == 1, F.array(e("SYNC_TRY", 1, queue, obj_id=obj), e("TASK_BLOCK", 2, queue, obj_id=obj, reason=F.lit(5))))
        .when(kind == 2, F.array(e("TASK_WAKEUP", 1, queue, obj_id=obj, wake_src=F.lit(3))))
        .when(kind.isin(3, 10), F.array(e("TASK_DISPATCH", 1, here, prio=prio, reason=F.lit(1))))
        .when(kind == 4, F.array(e("TASK_BLOCK", 1, queue, obj_id=obj, reason=F.lit(2))))
        .when(kind.isin(*TERMINAL), F.array(e("TASK_EXIT", 1, F.col("machine"), exit_code=code)))
        .when(kind == 9, F.array(e("TASK_READY", 1, queue, prio=prio, core_hint=F.col("machine"), reason=F.lit(2))))
    )
    out = r.select("place", "ts_raw", F.explode(names).alias("x")).select("x.core_id", "place", "x.sub", "ts_raw", "x.event_name", *[f"x.{f}" for f in fields]).unionByName(switches)
    return scan(out, ["core_id"], ["place", "sub"], number="seq", long=many).drop("place", "sub")
