"""Registered queries: retrieval and statistics over the star-schema and document tables, foreign formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import shared_dir
from ..operators import convert, retrieval, stats
from ..sources import text_traces
from ..sources.trace_view import trace_events
from .sql import with_views


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _chunks(s, d):
    return retrieval.doc_chunks(_table(s, d, "documents"))


def _queries(s):
    return s.sql("SELECT * FROM VALUES ('a', 'stupid', 1, 'stupid'), ('a', 'worthless', 2, 'stupid'), ('b', 'license', 1, 'mit license'), ('b', 'mit', 1, 'mit license') AS t(query_id, term, qtf, phrase)")


def _lines(s, d):
    return _table(s, d, "lineitem")


def _written(df, kind: str) -> str:
    """Trace events written as text lines of a foreign format, to be read back."""
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def _btf_path(s, d):
    e = trace_events(s, d).where("event_name in ('CTX_SWITCH', 'TASK_READY', 'SYNC_TRY', 'LOSS')")
    action = F.expr("case event_name when 'CTX_SWITCH' then 'start' when 'TASK_READY' then 'activate' when 'SYNC_TRY' then 'jump' else 'trigger' end")
    kind = F.expr("case event_name when 'LOSS' then 'STI' when 'SYNC_TRY' then 'T' else 'T' end")
    return _written(e.select(F.concat_ws(",", "ts_raw", F.concat(F.lit("Core_"), "core_id"), F.lit("0"), kind, F.concat(F.lit("T"), F.coalesce("task_id", F.lit(0))), F.lit("0"), action, F.when(F.col("event_name") == "TASK_READY", "create").otherwise("x"))), "btf")


def _systrace_path(s, d):
    e = trace_events(s, d).where("event_name in ('CTX_SWITCH', 'IRQ_ENTER', 'IRQ_EXIT', 'TASK_WAKEUP', 'TASK_READY', 'SYNC_LOCK', 'SYNC_UNLOCK')")  # the kinds that the format has
    call = F.expr(
        "case event_name when 'CTX_SWITCH' then format_string('sched_switch: prev_comm=p prev_pid=%d prev_state=%s ==> next_comm=n next_pid=%d', prev_task_id, if(reason = 1, 'S', 'R'), next_task_id)"
        " when 'TASK_READY' then format_string('sched_wakeup_new: comm=w pid=%d target_cpu=%d', task_id, core_id) when 'TASK_WAKEUP' then format_string('sched_%s: comm=w pid=%d target_cpu=%d', if(seq % 2 = 0, 'waking', 'wakeup'), task_id, (core_id + 1) % 4)"
        " when 'SYNC_LOCK' then element_at(array('sys_sem_wait()', 'sys_mutex_lock(a, b)', 'sys_nanosleep()'), cast(seq % 3 as int) + 1) when 'SYNC_UNLOCK' then element_at(array('sys_sem_wait -> 0', 'sys_mutex_lock -> -1', 'sys_sem_post -> 0'), cast(seq % 3 as int) + 1)"
        " when 'IRQ_ENTER' then format_string('irq_handler_entry: irq=%d', irq_id) else format_string('irq_handler_exit: irq=%d', irq_id) end"
    )
    stamp = F.expr("format_string('%d.%06d', ts_raw div 1000000, ts_raw % 1000000)")
    return _written(e.select(F.concat(F.lit("  trace"), "dataset_id", F.lit(".worker-"), F.coalesce("task_id", F.lit(0)), F.lit(" ["), F.lpad(F.col("core_id").cast("string"), 3, "0"), F.lit("] "), stamp, F.lit(": "), call)), "systrace")


def _systrace(s, d):
    """The lines read back, with the trace that the task's name tells."""
    return text_traces.scan_systrace(s, _systrace_path(s, d)).withColumn("dataset_id", F.regexp_extract("task_name", r"^trace(.+)\.worker$", 1))


def _telemetry(s, d, **how):
    e = _table(s, d, "orders")
    path = f"{shared_dir(s)}/telemetry-{uuid.uuid4().hex}"
    inner = F.struct(F.col("o_totalprice").alias("runtime"), (F.col("o_custkey") % 4096).cast("double").alias("rss"))
    e.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("dataset_id"), F.element_at(F.array(F.lit("full"), F.lit("clipped")), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("mode"), F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("family"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, inner).alias("metrics"), F.when(F.col("o_orderkey") % 2 == 1, inner).alias("telemetry_record")).write.json(path)
    return text_traces.scan_telemetry(s, path, ["runtime", "rss"], **how)


def _orders(s, d):
    return _table(s, d, "orders")


def _versions(s, d):
    """Orders as versions of their customers; every seventh customer has a cycle of three more beside them."""
    own = _orders(s, d).select("o_custkey", F.col("o_orderkey").alias("version"), F.expr("if(o_orderkey % 3 = 0, null, o_orderkey - o_orderkey % 3)").alias("prior"))
    n = 3 + F.col("o_custkey") % 2
    more = _orders(s, d).where("o_custkey % 7 = 0").select("o_custkey", n.alias("n"), F.explode(F.array(*map(F.lit, range(3)))).alias("x")).distinct()
    return own.unionByName(more.select("o_custkey", F.expr("x - n").alias("version"), F.expr("if(x = 0, 2 - n, x - 1 - n)").alias("prior")))


def _facts(s, d):
    """Collector counters of each core made from its events, with a few planted errors."""
    g = trace_events(s, d).groupBy("dataset_id", "core_id").agg(F.count("*").alias("accepted_records"), F.coalesce(F.sum("overflow_count"), F.lit(0)).alias("buffer_overflow_dropped_records"), F.count_if(F.col("event_name") == "SYNC_TRY").alias("rejected_payload_records"), F.count_if(F.col("event_name").isin("LOSS", "OVERFLOW")).alias("integrity_markers"), F.max("seq").alias("buffer_high_watermark"))
    n = "cast(dataset_id as bigint)"
    made = {
        "dropped_records": "buffer_overflow_dropped_records + rejected_payload_records", "attempted_records": f"accepted_records + dropped_records + if(core_id = 3 and {n} % 2 = 1, 1, 0)",
        "flushed_records": "accepted_records + integrity_markers", "decoded_records": "flushed_records - if(core_id = 2, 1, 0)", "loss_delta_total": "buffer_overflow_dropped_records", "overflow_delta_total": f"buffer_overflow_dropped_records + if({n} % 3 = 0, 1, 0)",
        "wire_frames": "flushed_records", "wire_bytes": f"if({n} % 5 = 3, null, 28 * flushed_records)", "inventory_frames": "flushed_records", "inventory_bytes": "if(core_id = 1, null, wire_bytes)", "buffer_capacity_records": "490",
        "crc_failures": "0", "truncations": "0", "backpressure_total": "0", "observed": f"{n} % 5 <> 4", "capacity_unit": "'records'", "watermark_unit": f"if(core_id = 0 and {n} % 2 = 1, 'bytes', 'records')",
    }
    for name, value in made.items():
        g = g.withColumn(name, F.expr(value))
    return g


#: By kind of record: the orders that lack it, and its fields; every rule with a remainder plants an error.
BUNDLE = {
    "ledger": ("false", {"session": "o_custkey % 7", "case_id": "o_custkey", "config": "o_orderkey % 5", "oar_digest": "o_orderkey + 4 + if(o_orderkey % 37 = 0, 1, 0)", "cvr_digest": "o_orderkey + 6"}),
    "ccm": ("o_orderkey % 17 = 0", {"session": "o_custkey % 7", "config": "o_orderkey % 5 + if(o_orderkey % 41 = 0, 1, 0)", "digest": "o_orderkey + 2"}),
    "cir": ("o_orderkey % 101 = 0", {"session": "o_custkey % 7", "ccm_digest": "o_orderkey + 2 + if(o_orderkey % 43 = 0, 1, 0)", "raw_id": "o_orderkey", "raw_hash": "o_orderkey * 3", "digest": "o_orderkey + 3", "complete": "o_orderkey % 9 <> 0"}),
    "oar": ("o_orderkey % 103 = 0", {"session": "o_custkey % 7 + if(o_orderkey % 19 = 0, 1, 0)", "case_id": "o_custkey + if(o_orderkey % 23 = 0, 1, 0)", "digest": "o_orderkey + 4", "complete": "o_orderkey % 8 <> 0"}),
    "inventory": ("o_orderkey % 107 = 0", {"session": "o_custkey % 7", "raw_id": "o_orderkey + if(o_orderkey % 47 = 0, 1, 0)", "raw_hash": "o_orderkey * 3 + if(o_orderkey % 29 = 0, 1, 0)", "digest": "o_orderkey + 5", "available": "o_orderkey % 7 <> 0"}),
    "cvr": (
        "o_orderkey % 109 = 0",
        {"session": "o_custkey % 7", "case_id": "o_custkey", "raw_id": "o_orderkey", "raw_hash": "o_orderkey * 3", "digest": "o_orderkey + 6 + if(o_orderkey % 31 = 0, 1, 0)", "ccm_digest": "o_orderkey + 2", "cir_digest": "o_orderkey + 3 + if(o_orderkey % 53 = 0, 1, 0)",
         "oar_digest": "o_orderkey + 4", "inventory_digest": "o_orderkey + 5 + if(o_orderkey % 59 = 0, 1, 0)", "status": "if(o_orderstatus = 'P', 'pending', if(o_orderkey % 6 = 0, 'invalid', 'valid'))"},
    ),
}


def _bundle(s, d):
    return {kind: _orders(s, d).where(f"not ({lacks})").select("o_orderkey", *[F.expr(v).alias(n) for n, v in fields.items()]) for kind, (lacks, fields) in BUNDLE.items()}


def _epochs(s, d):
    """Interrupt entries as an observer's epochs; the UART has those of two thirds of the interrupts, in ticks of a clock that is off."""
    e = trace_events(s, d).where("event_name = 'IRQ_ENTER'")
    observer = e.select("dataset_id", "core_id", F.col("seq").alias("epoch"), F.col("ts_raw").alias("at"))
    return observer, e.where("irq_id <> 3").select("dataset_id", "core_id", F.col("seq").alias("epoch"), F.expr("ts_raw + ts_raw div 1000000 % 7").alias("tick"))


def _replays(s, d):
    """Orders as replayed diagnoses: a status, the references of the evidence and those kept."""
    status = F.expr("element_at(array('pass', 'fail', 'reference', 'not_evaluated'), cast(o_orderkey % 4 + 1 as int))")
    refs = F.expr("transform(sequence(0, cast(o_orderkey % 5 as int)), i -> concat('r', o_custkey % 50 + i))")
    kept = F.expr("transform(filter(sequence(0, cast(o_orderkey % 7 as int)), i -> i % 2 = 0 or o_orderkey % 3 = 0), i -> concat('r', o_custkey % 50 + i))")
    return _orders(s, d).select("o_orderkey", "o_orderpriority", status.alias("status"), refs.alias("refs"), kept.alias("kept"))


def _events_json(s, d):
    payload = F.struct("task_id", "irq_id", F.col("reason").cast("string").alias("reason"))
    return _written(trace_events(s, d).select(F.to_json(F.struct("core_id", "event_name", "seq", F.col("ts_raw").alias("timestamp"), payload.alias("payload")))), "events")


def _vcd_path(s, d):
    """A dump of each trace's interrupt lines: entries raise the line of the interrupt, exits lower it, loss gives an unknown value; one file a trace, its times in order."""
    e = trace_events(s, d).where("event_name in ('IRQ_ENTER', 'IRQ_EXIT', 'LOSS')").withColumn("n", F.row_number().over(W.partitionBy("dataset_id").orderBy("ts_raw", "core_id", "seq")))
    bit = F.expr("case event_name when 'IRQ_ENTER' then '1' when 'IRQ_EXIT' then '0' else 'x' end")
    change = F.concat(F.lit("#"), F.expr("ts_raw div 1000000 - if(n % 50 = 0, 1000000, 0)"), F.lit("\n"), bit, F.lit("i"), F.coalesce("irq_id", F.lit(1)))
    body = e.groupBy("dataset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", change.alias("c")))), lambda x: x["c"]), "\n").alias("body"))
    head = "".join(f"$var wire 1 i{i} irq{i} $end\n" for i in (1, 2, 3))
    path = f"{shared_dir(s)}/vcd-{uuid.uuid4().hex}"
    body.select("dataset_id", F.concat(F.lit(head), "body").alias("value")).write.partitionBy("dataset_id").text(path)
    return path


def _cluster_path(s, d):
    """Orders as instance events of a cluster: collections of a customer, types and machines by rule, some without a machine or an end."""
    row = F.struct(
        F.col("o_custkey").alias("collection_id"), F.expr("cast(o_orderkey % 3 as int)").alias("instance_index"), F.expr("if(o_orderkey % 5 = 0, null, o_orderkey % 101 - 50)").alias("machine_id"), F.expr("cast(o_orderkey % 11 as int)").alias("type"),
        F.expr("cast(o_orderkey % 400 * 100 as int)").alias("priority"), F.expr("if(o_orderkey % 997 = 0, 9223372036854775807, o_orderkey * 10)").alias("time"),
    )
    return _written(_orders(s, d).select(F.to_json(row)), "cluster")


def _logic_path(s, d):
    """Line items as samples of two channels, a file an order priority: time in seconds and two levels."""
    rows = _orders(s, d).select("o_orderpriority", (F.col("o_orderkey") / 8).alias("t"), F.expr("o_custkey % 2").alias("a"), F.expr("o_custkey div 2 % 2").alias("b"))
    path = f"{shared_dir(s)}/logic-{uuid.uuid4().hex}"
    rows.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "t").write.partitionBy("o_orderpriority").option("header", True).csv(path)
    return path


#: Weights of the features that runs and cases share.
CASE_WEIGHTS = {"size": 5, "rss": 3, "phase": 2, "platform": 1}


def _runs(s, d):
    """Orders as runs: bucketised features, proposed actions, fields without telemetry."""
    return _orders(s, d).select(
        F.col("o_orderkey").alias("run_id"), F.expr("case when o_totalprice < 50000 then 'small' when o_totalprice < 200000 then 'medium' else 'large' end").alias("size"),
        F.expr("if(o_orderstatus = 'P', null, o_orderstatus)").alias("rss"), F.substring("o_orderpriority", 1, 1).alias("phase"), (F.col("o_custkey") % 3).alias("platform"),
        F.expr("array(concat('a', o_orderkey % 4))").alias("actions"), F.expr("if(o_orderkey % 3 = 0, array('rss', 'phase'), if(o_orderkey % 3 = 1, array('rss'), cast(array() as array<string>)))").alias("missing"),
    )


def _cases(s, d):
    """Customers as cases with labels, risk and reject reasons."""
    return _table(s, d, "customer").select(
        F.col("c_custkey").alias("case_id"), F.expr("case when c_acctbal < 1000 then 'small' when c_acctbal < 5000 then 'medium' else 'large' end").alias("size"),
        F.expr("if(c_custkey % 7 = 0, null, if(c_custkey % 2 = 0, 'O', 'F'))").alias("rss"), F.expr("cast(c_nationkey % 5 + 1 as string)").alias("phase"), (F.col("c_custkey") % 3).alias("platform"),
        F.expr("concat('a', c_custkey % 6)").alias("action"), F.expr("if(c_custkey % 2 = 0, array('rss'), array('phase', 'io'))").alias("missing"),
        F.expr("element_at(array('accept', 'reject', 'unsafe', 'abstain'), cast(c_custkey % 4 + 1 as int))").alias("label"), F.expr("if(c_nationkey % 2 = 0, 'high', 'low')").alias("risk"), F.expr("if(c_custkey % 5 = 0, '', 'policy')").alias("reject_reason"),
    )


def _counters(s, d):
    return _lines(s, d).groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_returnflag") != "R").alias("kept"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 1)).alias("closed"))


def _ledger(s, d):
    o = _orders(s, d)
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    digest = F.md5(F.col("o_orderkey").cast("string"))
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.select("o_custkey", "o_orderkey", n.alias("i"), digest.alias("digest"), F.md5(F.lag("o_orderkey").over(w).cast("string")).alias("previous_digest"))
    return rows.select("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("i") + 100).otherwise(F.col("i")).alias("append_sequence"), "digest", F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise(F.col("previous_digest")).alias("previous_digest"),
        F.expr("if(o_orderkey % 17 = 0, 0, o_orderkey)").alias("record_id"), F.expr("if(o_orderkey % 19 = 0, 's2', 's1')").alias("session"))


QUERIES = {
    "t01_doc_chunks": lambda s, d: _chunks(s, d).select("doc_id", "first_line", F.char_length("text").alias("n_chars")),
    "t02_tokenize": lambda s, d: retrieval.term_totals(_table(s, d, "documents")),
    "t03_tfidf_search": lambda s, d: retrieval.tfidf_search(_chunks(s, d), _queries(s)),
    "t04_snippet": lambda s, d: retrieval.snippet(_chunks(s, d), "license"),
    "t05_case_similarity": lambda s, d: retrieval.similar_cases(_runs(s, d), _cases(s, d), CASE_WEIGHTS, action=6, missing=2),
    "t05_case_summary": lambda s, d: retrieval.case_summary(retrieval.similar_cases(_runs(s, d), _cases(s, d), CASE_WEIGHTS, action=6, missing=2), _runs(s, d), _cases(s, d), threshold=8),
    "t06_run_statistics": lambda s, d: stats.run_statistics(_lines(s, d), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]),
    "t07_status_counts": lambda s, d: stats.status_counts(_orders(s, d), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]),
    "t08_telemetry_risk": lambda s, d: stats.telemetry_risk(_telemetry(s, d).withColumn("reused", F.col("at") % 3 == 0), "dataset_id", "at", "runtime", "rss", 50),
    "s11_scan_telemetry": lambda s, d: _telemetry(s, d).select("run_id", "runtime", "rss"),
    "s11_modes": lambda s, d: _telemetry(s, d, only={"mode": ["clipped"], "family": ["f0", "f2"]}).select("run_id", "mode", "family", "rss"),
    "s11_last_runs": lambda s, d: _telemetry(s, d, only={"dataset_id": ["1-URGENT", "2-HIGH"]}, last=20).select("dataset_id", "run_id", "runtime", "rss"),
    "t09_prior_training": lambda s, d: stats.prior_table(_lines(s, d).select((F.col("l_quantity") > 25).alias("f1"), (F.col("l_discount") > 0.05).alias("f2"), "l_extendedprice", F.array("l_returnflag", "l_linestatus").alias("acts")), ["f1", "f2"], "l_extendedprice", "acts"),
    "t12_feedback_summary": lambda s, d: stats.feedback_summary(_lines(s, d).select("l_returnflag", "l_suppkey", (F.col("l_linenumber") % 5).alias("clarity"), (F.col("l_quantity") % 5).alias("trust")), "l_returnflag", "l_suppkey", ["clarity", "trust"]),
    "t13_detector_eval": lambda s, d: stats.detector_eval(_table(s, d, "documents").join(_table(s, d, "labels"), "doc_id").select("lang", (F.col("doc_id") % 97).alias("case_id"), F.expr("array(n_chars % 3, 3 + n_chars % 2, n_chars % 7)").alias("kinds"), (F.col("toxic") == 0).alias("truth")), "lang", {"f1": [1, 3], "f2": [0, 4], "f3": [2]}),
    "t14_clock_drift": lambda s, d: stats.clock_drift(trace_events(s, d).where("event_name like 'IRQ%'"), "dataset_id", "ts_raw", 1e8),
    "t15_perturbation": lambda s, d: stats.perturbation(_lines(s, d).groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n")), "l_linestatus", "l_returnflag", "A", ["q", "n"]),
    "t16_counter_reconcile": lambda s, d: stats.reconcile(_counters(s, d), "l_suppkey", {"returns": "total = returned + kept", "status": "total = open + closed", "some": "returned > 0"}),
    "t16_collector_reconcile": lambda s, d: stats.reconcile_collector(_facts(s, d), ["dataset_id", "core_id"]),
    "j11_epoch_join": lambda s, d: stats.epoch_join(*_epochs(s, d), ["dataset_id", "core_id"])[0].select("dataset_id", "core_id", "epoch", "at", "tick"),
    "j11_foreign_epochs": lambda s, d: stats.epoch_join(*_epochs(s, d), ["dataset_id", "core_id"])[1].select("dataset_id", "core_id", "epoch"),
    "t14_clock_residual": lambda s, d: stats.clock_residual(stats.epoch_join(*_epochs(s, d), ["dataset_id", "core_id"])[0], ["dataset_id", "core_id"], 1.0),
    "t10_replay_summary": lambda s, d: stats.replay_summary(_replays(s, d), "o_orderpriority"),
    "t11_diagnosis_retention": lambda s, d: stats.retention(_replays(s, d).select(F.col("o_orderkey").alias("id"), "refs", "kept")),
    "s04_scan_events_json": lambda s, d: text_traces.scan_events_json(s, _events_json(s, d)).select("core_id", "event_name", "seq", "timestamp", "payload.task_id", "payload.irq_id", "payload.reason"),
    "s06_scan_vcd": lambda s, d: text_traces.scan_vcd(s, _vcd_path(s, d))[0].select("timestamp", "identifier", "value"),
    "s06_vcd_problems": lambda s, d: text_traces.scan_vcd(s, _vcd_path(s, d))[1].groupBy("reason").agg(F.count("*").alias("n")),
    "c03_vcd_to_semantic": lambda s, d: convert.vcd_to_semantic(text_traces.scan_vcd(s, _vcd_path(s, d))[0]).groupBy("semantic", "identifier").agg(F.count("*").alias("n"), F.sum("value").alias("ones")),
    "s08_scan_cluster_json": lambda s, d: text_traces.scan_cluster_json(s, _cluster_path(s, d)),
    "c02_cluster_to_events": lambda s, d: convert.cluster_to_events(text_traces.scan_cluster_json(s, _cluster_path(s, d))),
    "c02_cluster_buckets": lambda s, d: convert.cluster_to_events(text_traces.scan_cluster_json(s, _cluster_path(s, d)), buckets=4).groupBy("core_id", "event_name", "reason", "exit_code").agg(F.count("*").alias("n"), F.max("ts_raw").alias("last"), F.sum("seq").alias("seqs"), F.count_distinct("task_id").alias("tasks")),
    "s09_scan_logic_csv": lambda s, d: text_traces.scan_logic_csv(s, _logic_path(s, d), ["a", "b"])[0].drop("file"),
    "s09_logic_edges": lambda s, d: text_traces.scan_logic_csv(s, _logic_path(s, d), ["a", "b"])[1].drop("file"),
    "t17_raw_facts": lambda s, d: stats.raw_facts(trace_events(s, d)),
    "t18_ledger_chain": lambda s, d: stats.ledger_violations(_ledger(s, d), "o_custkey"),
    "t19_current_version": lambda s, d: stats.current_version(_versions(s, d), "o_custkey"),
    "t19_version_cycles": lambda s, d: stats.version_cycles(_versions(s, d), "o_custkey"),
    "t20_scoring_eligibility": lambda s, d: stats.bundle_violations(_bundle(s, d), "o_orderkey"),
    "j12_capture_bundle_join": lambda s, d: stats.capture_bundles(_bundle(s, d), "o_orderkey").select("o_orderkey", F.col("ledger.session").alias("session"), F.col("ccm.digest").alias("ccm_digest"), F.col("oar.complete").alias("observed"), F.col("cvr.status").alias("status")),
    "t21_epoch_pairing": lambda s, d: stats.epoch_pairing(trace_events(s, d).where("event_name = 'IRQ_ENTER'").select("dataset_id", F.expr("seq div 3").alias("epoch")), trace_events(s, d).where("event_name = 'IRQ_EXIT'").select("dataset_id", F.expr("seq div 3").alias("epoch")), "dataset_id"),
    "s05_scan_btf": lambda s, d: text_traces.scan_btf(s, _btf_path(s, d))[0],
    "s05_btf_rejects": lambda s, d: text_traces.scan_btf(s, _btf_path(s, d))[1].groupBy("reason").agg(F.count("*").alias("n")),
    "c03_btf_to_semantic": lambda s, d: convert.btf_to_semantic(text_traces.scan_btf(s, _btf_path(s, d))[0]).groupBy("semantic", "cpu").agg(F.count("*").alias("n")),
    "s07_scan_systrace": lambda s, d: _systrace(s, d).select("dataset_id", "tid", "cpu", "timestamp_ns"),
    "c01_systrace_to_events": lambda s, d: convert.systrace_to_events(_systrace(s, d)),
}

CHUNKS = "SELECT doc_id, i + 1 AS first_line, array_to_string(ls[i + 1:i + 32], chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) AS d, unnest(range(0, greatest(0, len(ls) - 5) + 1, 28)) AS u(i)"
Z = 1.959963984540054


def rate(k: str, n: str, name: str) -> str:
    p = f"(({k}) * 1.0 / ({n}))"
    half = f"{Z} * sqrt({p} * (1 - {p}) / ({n}) + {Z * Z} / (4.0 * ({n}) * ({n}))) / (1 + {Z * Z} / ({n}))"
    mid = f"({p} + {Z * Z} / (2.0 * ({n}))) / (1 + {Z * Z} / ({n}))"
    return f"CASE WHEN {n} > 0 THEN round({p}, 6) END AS {name}, CASE WHEN {n} > 0 THEN round({mid} - {half}, 6) END AS {name}_low, CASE WHEN {n} > 0 THEN round({mid} + {half}, 6) END AS {name}_high"


V = {
    "chunks": CHUNKS,
    "low": "SELECT doc_id, first_line, lower(text) AS t FROM chunks",
    "cjk": "SELECT doc_id, first_line, unnest(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]+')) AS run FROM low",
    "toks": """SELECT doc_id, first_line, term, count(*) AS tf FROM (SELECT doc_id, first_line, unnest(regexp_extract_all(t, '[a-z0-9_][a-z0-9_.:-]+')) AS term FROM low
  UNION ALL SELECT doc_id, first_line, unnest(string_split(run, '')) FROM cjk UNION ALL SELECT doc_id, first_line, substr(run, i, 2) FROM cjk, unnest(range(1, length(run))) AS u(i)) AS x GROUP BY ALL""",
    "qs": "SELECT * FROM (VALUES ('a', 'stupid', 1, 'stupid'), ('a', 'worthless', 2, 'stupid'), ('b', 'license', 1, 'mit license'), ('b', 'mit', 1, 'mit license')) AS t(query_id, term, qtf, phrase)",
    "lines3": "SELECT l_returnflag, unnest([{'metric': 'l_quantity', 'value': CAST(l_quantity AS double)}, {'metric': 'l_extendedprice', 'value': CAST(l_extendedprice AS double)}, {'metric': 'l_discount', 'value': CAST(l_discount AS double)}]) AS x FROM lineitem",
    "tele": "SELECT CAST(o_orderkey AS varchar) AS run_id, o_orderpriority AS dataset_id, o_orderkey AS ts, CAST(o_totalprice AS double) AS runtime, CAST(o_custkey % 4096 AS double) AS rss FROM orders",
    "runs": """SELECT o_orderkey AS run_id, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS rss, o_orderpriority[1] AS phase, o_custkey % 3 AS platform,
  ['a' || (o_orderkey % 4)] AS actions, CASE o_orderkey % 3 WHEN 0 THEN ['rss', 'phase'] WHEN 1 THEN ['rss'] ELSE [] END AS missing FROM orders""",
    "cases": """SELECT c_custkey AS case_id, CASE WHEN c_acctbal < 1000 THEN 'small' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'large' END AS size, CASE WHEN c_custkey % 7 <> 0 THEN CASE c_custkey % 2 WHEN 0 THEN 'O' ELSE 'F' END END AS rss, CAST(c_nationkey % 5 + 1 AS varchar) AS phase,
  c_custkey % 3 AS platform, 'a' || (c_custkey % 6) AS action, CASE c_custkey % 2 WHEN 0 THEN ['rss'] ELSE ['phase', 'io'] END AS missing, ['accept', 'reject', 'unsafe', 'abstain'][c_custkey % 4 + 1] AS label,
  CASE c_nationkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS risk, CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'policy' END AS reject_reason FROM customer""",
    "kinds": "SELECT DISTINCT size, rss, phase, platform, actions, missing FROM runs",
    "alike": """SELECT run_id, case_id, score, rank FROM runs AS r JOIN (SELECT *, row_number() OVER (PARTITION BY size, rss, phase, platform, actions, missing ORDER BY score DESC, case_id) AS rank FROM (
  SELECT k.*, case_id, CASE WHEN list_contains(actions, action) THEN 6 ELSE 0 END + CASE WHEN k.size IS NOT DISTINCT FROM c.size THEN 5 ELSE 0 END + CASE WHEN k.rss IS NOT DISTINCT FROM c.rss THEN 3 ELSE 0 END + CASE WHEN k.phase IS NOT DISTINCT FROM c.phase THEN 2 ELSE 0 END
    + CASE WHEN k.platform IS NOT DISTINCT FROM c.platform THEN 1 ELSE 0 END + 2 * len(list_intersect(k.missing, c.missing)) AS score FROM kinds AS k CROSS JOIN cases AS c) AS x QUALIFY rank <= 3) AS y
  ON r.size = y.size AND r.rss IS NOT DISTINCT FROM y.rss AND r.phase = y.phase AND r.platform = y.platform AND r.actions = y.actions AND r.missing = y.missing""",
    "conflicting": """SELECT run_id, action AS act FROM (SELECT s.run_id, action, list(DISTINCT label) AS ls FROM alike AS s JOIN cases USING (case_id) JOIN runs AS r ON r.run_id = s.run_id WHERE score >= 8 AND list_contains(actions, action) GROUP BY ALL) AS x
  WHERE list_contains(ls, 'accept') AND list_has_any(ls, ['reject', 'unsafe', 'abstain', 'needs_more_data']) OR list_contains(ls, 'unsafe') AND list_has_any(ls, ['reject', 'abstain', 'needs_more_data'])""",
    "facts0": """SELECT dataset_id, core_id, CAST(dataset_id AS bigint) AS d, count(*) AS accepted_records, CAST(coalesce(sum(overflow_count), 0) AS bigint) AS buffer_overflow_dropped_records, count(*) FILTER (WHERE event_name = 'SYNC_TRY') AS rejected_payload_records, count(*) FILTER (WHERE event_name IN ('LOSS', 'OVERFLOW')) AS integrity_markers,
  max(seq) AS buffer_high_watermark, 490 AS buffer_capacity_records FROM ev GROUP BY ALL""",
    "facts": """SELECT *, CASE WHEN core_id = 1 THEN NULL ELSE wire_bytes END AS inventory_bytes FROM (SELECT *, buffer_overflow_dropped_records + rejected_payload_records AS dropped_records, accepted_records + buffer_overflow_dropped_records + rejected_payload_records + CASE WHEN core_id = 3 AND d % 2 = 1 THEN 1 ELSE 0 END AS attempted_records,
  accepted_records + integrity_markers AS flushed_records, accepted_records + integrity_markers - CASE WHEN core_id = 2 THEN 1 ELSE 0 END AS decoded_records, buffer_overflow_dropped_records AS loss_delta_total, buffer_overflow_dropped_records + CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END AS overflow_delta_total,
  accepted_records + integrity_markers AS wire_frames, CASE WHEN d % 5 <> 3 THEN 28 * (accepted_records + integrity_markers) END AS wire_bytes, accepted_records + integrity_markers AS inventory_frames, d % 5 <> 4 AS observed, CASE WHEN core_id = 0 AND d % 2 = 1 THEN 'bytes' ELSE 'records' END AS watermark_unit FROM facts0) AS x""",
    "epochs": "SELECT dataset_id, core_id, seq AS epoch, ts_raw AS at_ts, CASE WHEN irq_id <> 3 THEN ts_raw + ts_raw // 1000000 % 7 END AS tick FROM ev WHERE event_name = 'IRQ_ENTER'",
    "replays": """SELECT o_orderkey, o_orderpriority, ['pass', 'fail', 'reference', 'not_evaluated'][o_orderkey % 4 + 1] AS status, list_transform(range(0, o_orderkey % 5 + 1), lambda i: 'r' || (o_custkey % 50 + i)) AS refs,
  list_transform(list_filter(range(0, o_orderkey % 7 + 1), lambda i: i % 2 = 0 OR o_orderkey % 3 = 0), lambda i: 'r' || (o_custkey % 50 + i)) AS kept FROM orders""",
    "vcd": """SELECT *, ts_raw // 1000000 - CASE WHEN n % 50 = 0 THEN 1000000 ELSE 0 END AS at_s FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts_raw, core_id, seq) AS n FROM ev WHERE event_name IN ('IRQ_ENTER', 'IRQ_EXIT', 'LOSS')) AS x""",
    "cluster": """SELECT o_custkey AS collection_id, CAST(o_orderkey % 3 AS int) AS instance_index, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 101 - 50 END AS machine_id, CAST(o_orderkey % 11 AS int) AS type, CAST(o_orderkey % 400 * 100 AS int) AS priority,
  CASE WHEN o_orderkey % 997 = 0 THEN 9223372036854775807 ELSE o_orderkey * 10 END AS at_ts FROM orders""",
    "logic": "SELECT *, lag(a) OVER w AS la, lag(b) OVER w AS lb FROM (SELECT o_orderpriority, o_orderkey / 8 AS t, o_custkey % 2 AS a, o_custkey // 2 % 2 AS b FROM orders) AS x WINDOW w AS (PARTITION BY o_orderpriority ORDER BY t)",
    "led": "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY append_sequence) AS n, lag(digest) OVER (PARTITION BY o_custkey ORDER BY append_sequence) AS before, count(*) OVER (PARTITION BY o_custkey, record_id) AS same_id, min(session) OVER (PARTITION BY o_custkey) AS s0, max(session) OVER (PARTITION BY o_custkey) AS s1 FROM led0",
    "led0": """SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN i + 100 ELSE i END AS append_sequence, digest, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE prev END AS previous_digest, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey END AS record_id, CASE WHEN o_orderkey % 19 = 0 THEN 's2' ELSE 's1' END AS session FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS i, md5(CAST(o_orderkey AS varchar)) AS digest,
  md5(CAST(lag(o_orderkey) OVER w AS varchar)) AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) AS x""",
    "vwalk": "SELECT o_custkey, version AS start, prior AS pos, 1 AS n FROM vers WHERE prior IS NOT NULL UNION ALL SELECT w.o_custkey, start, v.prior, n + 1 FROM vwalk AS w JOIN vers AS v ON v.o_custkey = w.o_custkey AND v.version = w.pos WHERE v.prior IS NOT NULL AND w.pos <> w.start AND n < 100",
    "vcycles": "SELECT o_custkey, cycle, count(*) AS length FROM (SELECT o_custkey, start, min(pos) AS cycle FROM vwalk GROUP BY ALL HAVING bool_or(pos = start)) AS x GROUP BY o_custkey, cycle",
    "vers": "SELECT o_custkey, o_orderkey AS version, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END AS prior FROM orders UNION ALL SELECT c, x - n, CASE WHEN x = 0 THEN 2 - n ELSE x - 1 - n END FROM (SELECT DISTINCT o_custkey AS c, 3 + o_custkey % 2 AS n FROM orders WHERE o_custkey % 7 = 0) AS z, range(3) AS t(x)",
    "cases97": """SELECT lang, doc_id % 97 AS case_id, 2 * count(*) FILTER (WHERE list_has_all(k, [1, 3]) OR list_has_all(k, [0, 4]) OR list_contains(k, 2)) > count(*) AS hit, bool_and(toxic = 0) AS truth
  FROM (SELECT *, [n_chars % 3, 3 + n_chars % 2, n_chars % 7] AS k FROM documents JOIN labels USING (doc_id)) AS x GROUP BY ALL""",
    "conf": "SELECT lang, count(*) AS n_case, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE NOT hit AND NOT truth) AS tn, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn FROM cases97 GROUP BY lang",
    "sums": "SELECT l_linestatus, l_returnflag, 'q' AS metric, CAST(sum(l_quantity) AS double) AS value FROM lineitem GROUP BY ALL UNION ALL SELECT l_linestatus, l_returnflag, 'n', CAST(count(*) AS double) FROM lineitem GROUP BY ALL",
    "btf": "SELECT ts_raw, core_id, event_name, coalesce(task_id, 0) AS t FROM ev WHERE event_name IN ('CTX_SWITCH', 'TASK_READY', 'SYNC_TRY', 'LOSS')",
    "sys": "SELECT * FROM ev WHERE event_name IN ('IRQ_ENTER', 'IRQ_EXIT', 'TASK_WAKEUP', 'CTX_SWITCH', 'TASK_READY', 'SYNC_LOCK', 'SYNC_UNLOCK')",
    "lin": """SELECT dataset_id, ts_raw * 1000 AS ts, core_id AS cpu, coalesce(task_id, 0) AS tid, event_name AS name, task_id, prev_task_id, next_task_id, irq_id, CASE event_name WHEN 'CTX_SWITCH' THEN prev_task_id WHEN 'IRQ_ENTER' THEN NULL WHEN 'IRQ_EXIT' THEN NULL ELSE task_id END AS subject,
    event_name = 'CTX_SWITCH' AND reason = 1 AS asleep, CASE event_name WHEN 'SYNC_LOCK' THEN ['sem_wait', 'mutex_lock', 'nanosleep'][seq % 3 + 1] WHEN 'SYNC_UNLOCK' THEN ['sem_wait', 'mutex_lock', 'sem_post'][seq % 3 + 1] END AS call,
    CASE event_name WHEN 'CTX_SWITCH' THEN 'sched_switch: prev_comm=p prev_pid=' || prev_task_id || ' prev_state=' || CASE WHEN reason = 1 THEN 'S' ELSE 'R' END WHEN 'TASK_READY' THEN 'sched_wakeup_new' WHEN 'TASK_WAKEUP' THEN 'sched_' || CASE WHEN seq % 2 = 0 THEN 'waking' ELSE 'wakeup' END
      WHEN 'SYNC_LOCK' THEN ['sys_sem_wait()', 'sys_mutex_lock(a, b)', 'sys_nanosleep()'][seq % 3 + 1] WHEN 'SYNC_UNLOCK' THEN ['sys_sem_wait -> 0', 'sys_mutex_lock -> -1', 'sys_sem_post -> 0'][seq % 3 + 1] WHEN 'IRQ_ENTER' THEN 'irq_handler_entry' ELSE 'irq_handler_exit' END AS payload FROM sys""",
    "lin1": "SELECT *, sum(CASE name WHEN 'IRQ_ENTER' THEN 1 WHEN 'IRQ_EXIT' THEN -1 ELSE 0 END) OVER (PARTITION BY dataset_id, cpu ORDER BY ts, tid, payload) AS walk FROM lin",
    "lin2": "SELECT *, walk - least(0, min(walk) OVER (PARTITION BY dataset_id, cpu ORDER BY ts, tid, payload)) AS level, last_value(CASE name WHEN 'SYNC_LOCK' THEN call WHEN 'SYNC_UNLOCK' THEN '' END IGNORE NULLS) OVER (PARTITION BY dataset_id, subject ORDER BY ts, cpu, tid, payload ROWS UNBOUNDED PRECEDING) AS active FROM lin1",
    "lin3": "SELECT *, lag(active) OVER w AS before, last_value(CASE WHEN asleep AND prev_task_id > 0 THEN coalesce(active, '') END IGNORE NULLS) OVER w AS block FROM lin2 WINDOW w AS (PARTITION BY dataset_id, subject ORDER BY ts, cpu, tid, payload ROWS UNBOUNDED PRECEDING)",
    "lin4": """SELECT *, CASE WHEN subject IS NULL THEN NULL WHEN block LIKE '%sleep' THEN 1 WHEN block LIKE 'mutex%' THEN 3 WHEN block LIKE 'sem%' THEN 4 ELSE 2 END AS why, CASE WHEN coalesce(block, '') = '' THEN 0 ELSE CAST('0x' || substr(md5(block || ':' || subject), 1, 15) AS bigint) END AS bobj,
    CASE WHEN level > 0 THEN 5 WHEN asleep THEN 3 ELSE 1 END AS how, CAST('0x' || substr(md5(CASE WHEN name = 'SYNC_UNLOCK' AND coalesce(before, '') <> '' THEN before ELSE call END || ':' || subject), 1, 15) AS bigint) AS obj, CASE WHEN call LIKE 'mutex%' THEN 1 ELSE 2 END AS typ FROM lin3""",
    "lin5": """SELECT dataset_id, cpu AS core_id, ts, cpu, tid, payload, 0 AS sub, 'TASK_READY' AS event_name, task_id, NULL AS prev_task_id, NULL AS next_task_id, NULL AS irq_id, NULL AS nesting_depth, 1 AS reason, NULL AS obj_id, NULL AS obj_type, NULL AS wake_src FROM lin4 WHERE name = 'TASK_READY'
  UNION ALL SELECT dataset_id, (cpu + 1) % 4, ts, cpu, tid, payload, 0, name, task_id, NULL, NULL, NULL, NULL, NULL, bobj, NULL, CASE WHEN level > 0 THEN 4 WHEN why = 1 THEN 2 WHEN why = 2 THEN 3 ELSE 1 END FROM lin4 WHERE name = 'TASK_WAKEUP'
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 0, 'TASK_BLOCK', prev_task_id, NULL, NULL, NULL, NULL, why, bobj, NULL, NULL FROM lin4 WHERE asleep AND prev_task_id > 0
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 1, 'TASK_DISPATCH', next_task_id, NULL, NULL, NULL, NULL, how, NULL, NULL, NULL FROM lin4 WHERE name = 'CTX_SWITCH' AND next_task_id > 0
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 2, name, next_task_id, prev_task_id, next_task_id, NULL, NULL, how, NULL, NULL, NULL FROM lin4 WHERE name = 'CTX_SWITCH'
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 0, name, NULL, NULL, NULL, irq_id, level + CASE name WHEN 'IRQ_EXIT' THEN 1 ELSE 0 END, NULL, NULL, NULL, NULL FROM lin4 WHERE name LIKE 'IRQ%'
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 0, 'SYNC_TRY', task_id, NULL, NULL, NULL, NULL, NULL, obj, typ, NULL FROM lin4 WHERE name = 'SYNC_LOCK' AND call <> 'nanosleep'
  UNION ALL SELECT dataset_id, cpu, ts, cpu, tid, payload, 0, CASE call WHEN 'sem_wait' THEN 'SYNC_LOCK' ELSE 'SYNC_UNLOCK' END, task_id, NULL, NULL, NULL, NULL, NULL, obj, typ, NULL FROM lin4 WHERE name = 'SYNC_UNLOCK' AND call <> 'mutex_lock'""",
    "cl0": """SELECT collection_id, instance_index, nullif(machine_id, 0) AS mid, type, least(greatest(coalesce(priority, 0), -32768), 32767) AS prio, at_ts, row_number() OVER (ORDER BY at_ts, collection_id, instance_index, type, nullif(machine_id, 0) NULLS FIRST) AS place,
    sum(CASE WHEN at_ts = 9223372036854775807 THEN 1 ELSE 0 END) OVER (ORDER BY at_ts, collection_id, instance_index, type, nullif(machine_id, 0) NULLS FIRST ROWS UNBOUNDED PRECEDING) AS nevers FROM cluster""",
    "cl1": """SELECT *, CAST(CASE WHEN at_ts = 9223372036854775807 THEN (SELECT max(at_ts) FROM cluster WHERE at_ts < 9223372036854775807) + nevers ELSE at_ts END AS bigint) AS ts_raw, min(place) OVER (PARTITION BY collection_id, instance_index) AS tfirst,
    CASE WHEN type IN (1, 4, 5, 6, 7, 8) THEN 1 ELSE 0 END AS leaves FROM cl0""",
    "mids": "SELECT mid, row_number() OVER (ORDER BY min(place)) AS machine FROM cl0 WHERE mid IS NOT NULL GROUP BY mid",
    "cl2": "SELECT c.*, dense_rank() OVER (ORDER BY tfirst) AS task_id, coalesce(machine, 0) AS machine, sum(leaves) OVER (PARTITION BY tfirst ORDER BY place) - leaves AS run FROM cl1 AS c LEFT JOIN mids USING (mid)",
    "cl2b": "SELECT * EXCLUDE (machine), CASE WHEN mid IS NULL THEN 0 ELSE 1 + abs(mid) % 4 END AS machine FROM cl2",
}
for b in ("", "b"):
    V |= {
        f"cl3{b}": f"SELECT *, last_value(CASE WHEN type = 3 AND machine > 0 THEN machine END IGNORE NULLS) OVER (PARTITION BY task_id, run ORDER BY place ROWS UNBOUNDED PRECEDING) AS named FROM cl2{b}",
        f"cl4{b}": f"SELECT *, last_value(CASE WHEN type = 3 THEN coalesce(named, 1) END IGNORE NULLS) OVER (PARTITION BY task_id, run ORDER BY place ROWS UNBOUNDED PRECEDING) AS running FROM cl3{b}",
        f"cl5{b}": f"SELECT *, lag(running) OVER (PARTITION BY task_id, run ORDER BY place) AS before FROM cl4{b}",
        f"occ0{b}": f"""SELECT running AS core, place, 0 AS sub, task_id, CASE WHEN type IN (1, 4) THEN 3 ELSE 6 END AS why, ts_raw FROM cl5{b} WHERE leaves = 1 AND running IS NOT NULL
  UNION ALL SELECT before, place, 0, task_id, 2, ts_raw FROM cl5{b} WHERE type = 3 AND before <> running UNION ALL SELECT running, place, 2, task_id, NULL, ts_raw FROM cl5{b} WHERE type = 3""",
        f"occ1{b}": f"SELECT *, last_value(CASE WHEN sub = 2 THEN task_id END IGNORE NULLS) OVER (PARTITION BY core ORDER BY place, sub ROWS UNBOUNDED PRECEDING) AS holder FROM occ0{b}",
        f"occ2{b}": f"SELECT *, coalesce(last_value(CASE WHEN sub = 2 THEN task_id WHEN holder = task_id THEN 0 END IGNORE NULLS) OVER (PARTITION BY core ORDER BY place, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM occ1{b}",
        f"cl6{b}": f"""SELECT core AS core_id, place, sub, ts_raw, 'CTX_SWITCH' AS event_name, CASE sub WHEN 0 THEN 0 ELSE task_id END AS task_id, NULL AS prio, NULL AS core_hint, CASE WHEN sub = 0 THEN why WHEN held = 0 THEN 1 ELSE 2 END AS reason, NULL AS obj_id,
    CASE sub WHEN 0 THEN task_id ELSE held END AS prev_task_id, CASE sub WHEN 0 THEN 0 ELSE task_id END AS next_task_id, NULL AS exit_code, NULL AS wake_src FROM occ2{b} WHERE sub = 0 AND holder = task_id OR sub = 2 AND held <> task_id
  UNION ALL SELECT 0, place, 1, ts_raw, 'TASK_READY', task_id, prio, machine, CASE WHEN type = 0 AND place = tfirst THEN 1 ELSE 2 END, NULL, NULL, NULL, NULL, NULL FROM cl5{b} WHERE type IN (0, 9)
  UNION ALL SELECT 0, place, 1, ts_raw, 'SYNC_TRY', task_id, NULL, NULL, NULL, collection_id, NULL, NULL, NULL, NULL FROM cl5{b} WHERE type = 1
  UNION ALL SELECT 0, place, CASE type WHEN 1 THEN 2 ELSE 1 END, ts_raw, 'TASK_BLOCK', task_id, NULL, NULL, CASE type WHEN 1 THEN 5 ELSE 2 END, collection_id, NULL, NULL, NULL, NULL FROM cl5{b} WHERE type IN (1, 4)
  UNION ALL SELECT 0, place, 1, ts_raw, 'TASK_WAKEUP', task_id, NULL, NULL, NULL, collection_id, NULL, NULL, NULL, 3 FROM cl5{b} WHERE type = 2
  UNION ALL SELECT CASE WHEN type = 3 THEN running WHEN running IS NOT NULL THEN running ELSE greatest(machine, 1) END, place, 1, ts_raw, 'TASK_DISPATCH', task_id, prio, NULL, 1, NULL, NULL, NULL, NULL, NULL FROM cl5{b} WHERE type IN (3, 10)
  UNION ALL SELECT machine, place, 1, ts_raw, 'TASK_EXIT', task_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE type WHEN 5 THEN 1 WHEN 6 THEN 0 WHEN 7 THEN 137 ELSE 2 END, NULL FROM cl5{b} WHERE type IN (5, 6, 7, 8)""",
        f"cl7{b}": f"SELECT *, row_number() OVER (PARTITION BY core_id ORDER BY place, sub) AS seq FROM cl6{b}",
    }

V["bundle"] = "SELECT o_orderkey, " + ", ".join(f"CASE WHEN NOT ({lacks}) THEN {v} END AS {kind}_{n}" for kind, (lacks, fields) in BUNDLE.items() for n, v in fields.items()) + " FROM orders"
SQL = {
    "t01_doc_chunks": "SELECT doc_id, CAST(first_line AS int) AS first_line, CAST(length(text) AS int) AS n_chars FROM chunks",
    "t02_tokenize": "SELECT term, count(*) AS df, CAST(sum(tf) AS bigint) AS tf FROM toks GROUP BY term",
    "t03_tfidf_search": """SELECT query_id, CAST(rank AS int) AS rank, doc_id, CAST(first_line AS int) AS first_line, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, first_line) AS rank FROM (
  SELECT query_id, s.doc_id, s.first_line, round(s + CASE WHEN contains(lower(c.text), phrase) THEN 5.0 ELSE 0.0 END, 6) AS score FROM (SELECT query_id, doc_id, first_line, phrase, sum(qtf * tf * (1 + ln((SELECT count(*) FROM chunks) * 1.0 / df))) AS s FROM toks JOIN qs USING (term)
    JOIN (SELECT term, count(*) AS df FROM toks GROUP BY term) AS f USING (term) GROUP BY ALL) AS s JOIN chunks AS c ON c.doc_id = s.doc_id AND c.first_line = s.first_line) AS x) AS y WHERE rank <= 5""",
    "t04_snippet": "SELECT doc_id, CAST(first_line AS int) AS first_line, substr(text, greatest(1, p - 80), 167) AS snippet FROM (SELECT *, strpos(lower(text), 'license') AS p FROM chunks) AS x WHERE p > 0",
    "t05_case_similarity": "SELECT run_id, case_id, CAST(score AS int) AS score, CAST(rank AS int) AS rank FROM alike",
    "t05_case_summary": """SELECT r.run_id, count(case_id) AS matched, count(case_id) FILTER (WHERE score >= 8) AS "similar", coalesce(max(score), 0) AS top_score, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE score >= 8)), ','), '') AS labels,
  coalesce(array_to_string(list_sort(list(DISTINCT c.act) FILTER (WHERE c.act IS NOT NULL)), ','), '') AS conflicts, coalesce(bool_or(score >= 8 AND label = 'unsafe' AND risk = 'high' AND list_contains(actions, action)), false) AS unsafe_match,
  CASE WHEN count(*) FILTER (WHERE label IN ('reject', 'unsafe')) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE label IN ('reject', 'unsafe') AND reject_reason <> '') * 1.0 / count(*) FILTER (WHERE label IN ('reject', 'unsafe')), 6) END AS reject_coverage
  FROM runs AS r LEFT JOIN (SELECT s.run_id, s.score, k.* FROM alike AS s JOIN cases AS k USING (case_id)) AS m ON m.run_id = r.run_id LEFT JOIN conflicting AS c ON c.run_id = r.run_id AND c.act = m.action GROUP BY ALL""",
    "t06_run_statistics": "SELECT l_returnflag, x.metric AS metric, count(x.value) AS n, round(median(x.value), 6) AS median, quantile_disc(x.value, 0.95) AS p95, min(x.value) AS least, max(x.value) AS most FROM lines3 GROUP BY ALL",
    "t07_status_counts": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY ALL",
    "t08_telemetry_risk": "SELECT dataset_id, max(runtime) AS max_runtime, max(rss) AS max_rss, count(*) FILTER (WHERE rss >= 2048) AS heavy, count(*) FILTER (WHERE ts % 3 = 0) AS reused, count(*) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, runtime DESC) AS n FROM tele) AS x WHERE n <= 50 GROUP BY dataset_id",
    "s11_scan_telemetry": "SELECT run_id, runtime, rss FROM tele",
    "s11_modes": "SELECT CAST(o_orderkey AS varchar) AS run_id, 'clipped' AS mode, 'f' || o_custkey % 3 AS family, CAST(o_custkey % 4096 AS double) AS rss FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 3 IN (0, 2)",
    "s11_last_runs": "SELECT dataset_id, run_id, runtime, rss FROM tele WHERE dataset_id IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, run_id) <= 20",
    "t09_prior_training": """SELECT bucket, action, support, rows, mean, round(support * 1.0 / rows, 6) AS share FROM (SELECT CAST(CAST(l_quantity > 25 AS int) AS varchar) || CAST(CAST(l_discount > 0.05 AS int) AS varchar) AS bucket, a AS action, count(*) AS support FROM lineitem, unnest([l_returnflag, l_linestatus]) AS u(a) GROUP BY ALL) AS s
  JOIN (SELECT CAST(CAST(l_quantity > 25 AS int) AS varchar) || CAST(CAST(l_discount > 0.05 AS int) AS varchar) AS bucket, count(*) AS rows, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY ALL) AS z USING (bucket)""",
    "t12_feedback_summary": """SELECT l_returnflag, x.rating AS rating, count(x.v) FILTER (WHERE n = 1) AS n, round(avg(x.v) FILTER (WHERE n = 1), 6) AS mean, min(x.v) FILTER (WHERE n = 1) AS least, max(x.v) FILTER (WHERE n = 1) AS most, count(*) FILTER (WHERE n > 1) AS repeats
  FROM (SELECT l_returnflag, n, unnest([{'rating': 'clarity', 'v': CAST(clarity AS double)}, {'rating': 'trust', 'v': CAST(trust AS double)}]) AS x FROM (SELECT l_returnflag, l_linenumber % 5 AS clarity, l_quantity % 5 AS trust, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_linenumber % 5, l_quantity % 5) AS n FROM lineitem) AS y) AS z GROUP BY ALL""",
    "t13_detector_eval": f"SELECT lang, n_case, tp, tn, fp, fn, {rate('tp', 'tp + fn', 'sensitivity')}, {rate('tn', 'tn + fp', 'specificity')}, {rate('tp + tn', 'n_case', 'accuracy')} FROM conf",
    "t14_clock_drift": "SELECT dataset_id, count(*) AS n, round(avg(gap), 3) AS mean, round(median(gap), 3) AS median, round(stddev_samp(gap), 3) AS sd, CAST(quantile_disc(gap, 0.95) AS double) AS p95, round((avg(gap) / 1e8 - 1) * 1e6, 3) AS drift_ppm FROM (SELECT dataset_id, ts_raw - lag(ts_raw) OVER (PARTITION BY dataset_id ORDER BY ts_raw) AS gap FROM ev WHERE event_name LIKE 'IRQ%') AS x WHERE gap IS NOT NULL GROUP BY ALL",
    "t15_perturbation": """SELECT l_linestatus, v.l_returnflag, v.metric, CASE WHEN b.value IS NULL THEN 'NO_BASE' WHEN b.value = 0 THEN 'ZERO_BASE' ELSE 'OK' END AS status, round((v.value - b.value) / b.value, 6) AS relative
  FROM sums AS v LEFT JOIN (SELECT l_linestatus, metric, value FROM sums WHERE l_returnflag = 'A') AS b USING (l_linestatus, metric) WHERE v.l_returnflag <> 'A'""",
    "t16_counter_reconcile": """SELECT l_suppkey, array_to_string(list_filter([CASE WHEN total <> closed + op THEN 'status' END, CASE WHEN returned = 0 THEN 'some' END], lambda x: x IS NOT NULL), ',') AS failing, total = closed + op AND returned > 0 AS consistent
  FROM (SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS op, count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 1) AS closed FROM lineitem GROUP BY ALL) AS x""",
    "t16_collector_reconcile": f"""SELECT dataset_id, core_id, CASE WHEN observed THEN 'observed' ELSE 'not_observed' END AS observation_state, r = '' AS passed, r AS reasons FROM (SELECT *, CASE WHEN NOT observed THEN 'COUNTERS_NOT_OBSERVED' WHEN wire_bytes IS NULL THEN 'COUNTERS_INCOMPLETE'
  WHEN watermark_unit <> 'records' THEN 'UNITS' ELSE array_to_string(list_filter([{", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n.upper()}' END" for n, c in stats.EQUATIONS.items())}], lambda x: x IS NOT NULL), ',') END AS r FROM facts) AS x""",
    "j11_epoch_join": "SELECT dataset_id, core_id, epoch, at_ts AS at, tick FROM epochs WHERE tick IS NOT NULL",
    "j11_foreign_epochs": "SELECT dataset_id, core_id, epoch FROM epochs WHERE tick IS NULL",
    "t14_clock_residual": """SELECT dataset_id, core_id, count(*) AS n, round(avg(r), 3) AS mean_residual, round(CAST(max(abs(r)) AS double), 3) AS max_residual FROM (SELECT dataset_id, core_id, (at_ts - lag(at_ts) OVER w) - (tick - lag(tick) OVER w) AS r FROM epochs WHERE tick IS NOT NULL WINDOW w AS (PARTITION BY dataset_id, core_id ORDER BY epoch)) AS x
  WHERE r IS NOT NULL GROUP BY ALL""",
    "t10_replay_summary": """SELECT *, CASE WHEN wanted > 0 THEN round(retained * 1.0 / wanted, 6) END AS retention FROM (SELECT o_orderpriority, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'reference') AS reference,
  count(*) FILTER (WHERE status = 'not_evaluated') AS not_evaluated, CAST(sum(len(list_intersect(kept, refs))) AS bigint) AS retained, CAST(sum(len(refs)) AS bigint) AS wanted FROM replays GROUP BY ALL) AS g""",
    "t11_diagnosis_retention": """SELECT o_orderkey AS id, CAST(len(list_intersect(refs, kept)) AS int) AS shared, array_to_string(list_sort(list_concat(list_filter(refs, lambda x: NOT list_contains(kept, x)), list_filter(kept, lambda x: NOT list_contains(refs, x)))), ',') AS changed FROM replays""",
    "s04_scan_events_json": "SELECT core_id, event_name, seq, ts_raw AS timestamp, task_id, irq_id, CAST(reason AS varchar) AS reason FROM ev",
    "s06_scan_vcd": "SELECT at_s AS timestamp, 'i' || irq_id AS identifier, CASE event_name WHEN 'IRQ_ENTER' THEN 1 ELSE 0 END AS value FROM vcd WHERE event_name <> 'LOSS'",
    "s06_vcd_problems": "SELECT 'UNSUPPORTED_VALUE' AS reason, count(*) AS n FROM vcd WHERE event_name = 'LOSS' UNION ALL SELECT 'TIMESTAMP_REGRESSION', count(*) FROM (SELECT *, max(at_s) OVER (PARTITION BY dataset_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS latest FROM vcd) AS x WHERE at_s < latest",
    "c03_vcd_to_semantic": "SELECT 'marker' AS semantic, 'i' || irq_id AS identifier, count(*) AS n, count(*) FILTER (WHERE event_name = 'IRQ_ENTER') AS ones FROM vcd WHERE event_name <> 'LOSS' GROUP BY ALL",
    "s08_scan_cluster_json": "SELECT collection_id, instance_index, machine_id, type, priority, at_ts AS time, CAST(NULL AS int) AS missing_type FROM cluster",
    "c02_cluster_to_events": "SELECT * EXCLUDE (place, sub) FROM cl7",
    "c02_cluster_buckets": "SELECT core_id, event_name, reason, exit_code, count(*) AS n, max(ts_raw) AS last, CAST(sum(seq) AS bigint) AS seqs, count(DISTINCT task_id) AS tasks FROM cl7b GROUP BY ALL",
    "s09_scan_logic_csv": "SELECT t AS time, CAST(a AS int) AS a, CAST(b AS int) AS b FROM logic WHERE a IS DISTINCT FROM la OR b IS DISTINCT FROM lb",
    "s09_logic_edges": "SELECT t AS time FROM logic WHERE a = 1 AND la = 0",
    "t17_raw_facts": "SELECT dataset_id, CAST(coalesce(sum(greatest(step, 0)), 0) AS bigint) AS missing, CAST(coalesce(sum(lost_count), 0) AS bigint) AS lost, CAST(coalesce(sum(overflow_count), 0) AS bigint) AS overflowed FROM (SELECT *, seq - lag(seq) OVER (PARTITION BY dataset_id, core_id ORDER BY seq) - 1 AS step FROM ev) AS x GROUP BY dataset_id",
    "t18_ledger_chain": "SELECT * FROM (SELECT o_custkey, append_sequence, array_to_string(list_filter([CASE WHEN append_sequence <> n THEN 'SEQUENCE' END, CASE WHEN previous_digest IS DISTINCT FROM before THEN 'CHAIN' END, CASE WHEN same_id > 1 THEN 'DUPLICATE_ID' END, CASE WHEN s0 <> s1 THEN 'SESSION' END], lambda x: x IS NOT NULL), ',') AS violation FROM led) AS x WHERE violation <> ''",
    "t19_current_version": """SELECT o_custkey, versions, n - versions AS repeated, leaves, forks, dangling, roots, coalesce(cycles, 0) AS cycles, CAST(coalesce(cycle_records, 0) AS bigint) AS cycle_records,
  CASE WHEN leaves = 1 AND forks = 0 AND dangling = 0 AND roots = 1 AND n = versions AND cycles IS NULL THEN leaf END AS current FROM (
  SELECT o_custkey, count(*) FILTER (WHERE followers IS NULL) AS leaves, count(*) FILTER (WHERE followers > 1) AS forks, count(*) FILTER (WHERE own IS NULL) AS dangling, max(version) FILTER (WHERE followers IS NULL) AS leaf
  FROM (SELECT DISTINCT o_custkey, version, 1 AS own FROM vers) AS v FULL JOIN (SELECT o_custkey, prior AS version, count(*) AS followers FROM vers WHERE prior IS NOT NULL GROUP BY ALL) AS p USING (o_custkey, version) GROUP BY o_custkey) AS g
  JOIN (SELECT o_custkey, count(DISTINCT version) AS versions, count(*) AS n, count(*) FILTER (WHERE prior IS NULL) AS roots FROM vers GROUP BY ALL) AS k USING (o_custkey)
  LEFT JOIN (SELECT o_custkey, count(*) AS cycles, sum(length) AS cycle_records FROM vcycles GROUP BY o_custkey) AS c USING (o_custkey)""",
    "t19_version_cycles": "SELECT * FROM vcycles",
    "t20_scoring_eligibility": f"""SELECT o_orderkey, v AS violation, v = '' AND coalesce(cvr_status = 'valid' AND inventory_available AND cir_complete AND oar_complete, false) AS eligible FROM (SELECT *, array_to_string(list_filter([{
        ", ".join([f"CASE WHEN {k}_session IS NULL THEN 'NO_{k.upper()}' END" for k in stats.KINDS] + ["CASE WHEN " + " OR ".join(f"coalesce({b[0].replace('.', '_')} <> {r.replace('.', '_')}, false)" for r in b[1:]) + f" THEN '{n}' END" for n, b in stats.BINDINGS.items()])
    }], lambda x: x IS NOT NULL), ',') AS v FROM bundle) AS x""",
    "j12_capture_bundle_join": "SELECT o_orderkey, ledger_session AS session, ccm_digest, oar_complete AS observed, cvr_status AS status FROM bundle",
    "t21_epoch_pairing": """SELECT dataset_id, count(*) FILTER (WHERE e IS NULL) AS unended, count(*) FILTER (WHERE b IS NULL) AS unbegun, count(*) FILTER (WHERE b AND e) AS pairs, max(epoch) FILTER (WHERE b AND e) - min(epoch) FILTER (WHERE b AND e) + 1 = count(*) FILTER (WHERE b AND e) AS contiguous FROM
  (SELECT DISTINCT dataset_id, seq // 3 AS epoch, true AS b FROM ev WHERE event_name = 'IRQ_ENTER') AS x FULL JOIN (SELECT DISTINCT dataset_id, seq // 3 AS epoch, true AS e FROM ev WHERE event_name = 'IRQ_EXIT') AS y USING (dataset_id, epoch) GROUP BY dataset_id""",
    "s05_scan_btf": "SELECT ts_raw AS timestamp, 'Core_' || core_id AS subject, CASE event_name WHEN 'LOSS' THEN 'STI' ELSE 'T' END AS kind, 'T' || t AS target, CASE event_name WHEN 'CTX_SWITCH' THEN 'start' WHEN 'TASK_READY' THEN 'activate' ELSE 'trigger' END AS action, CASE event_name WHEN 'TASK_READY' THEN 'create' ELSE 'x' END AS detail FROM btf WHERE event_name <> 'SYNC_TRY'",
    "s05_btf_rejects": "SELECT 'ACTION' AS reason, count(*) AS n FROM btf WHERE event_name = 'SYNC_TRY'",
    "c03_btf_to_semantic": "SELECT CASE event_name WHEN 'TASK_READY' THEN 'task_create' WHEN 'CTX_SWITCH' THEN 'context_switch' ELSE 'marker' END AS semantic, core_id AS cpu, count(*) AS n FROM btf WHERE event_name <> 'SYNC_TRY' GROUP BY ALL",
    "s07_scan_systrace": "SELECT dataset_id, coalesce(task_id, 0) AS tid, core_id AS cpu, ts_raw * 1000 AS timestamp_ns FROM sys",
    "c01_systrace_to_events": "SELECT dataset_id, core_id, row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY ts, cpu, tid, payload, sub) AS seq, ts AS ts_raw, event_name, task_id, prev_task_id, next_task_id, irq_id, nesting_depth, reason, obj_id, obj_type, wake_src FROM lin5",
}
ORACLE = {k: with_views(v, V) for k, v in SQL.items()}
