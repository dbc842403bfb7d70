"""Comparison of baseline and candidate traces, dimension by dimension.

Both sides come as tables with a ``pair`` key that names what is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a table whose dataset_id counts from 0: even datasets are baselines, each odd one the candidate of the one before."""
    n = F.col("dataset_id").cast("long")
    keyed = df.withColumn("pair", F.floor(n / 2))
    return keyed.where(n % 2 == 0).drop("dataset_id"), keyed.where(n % 2 == 1).drop("dataset_id")


def outer(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of both sides; a missing side counts as 0. Adds b_, c_ and d_ (delta) columns."""
    base, cand = sides(df)
    b = base.select("pair", *keys, *[F.col(v).alias(f"b_{v}") for v in values])
    c = cand.select("pair", *keys, *[F.col(v).alias(f"c_{v}") for v in values])
    j = b.join(c, ["pair", *keys], "full")
    both = j.withColumns({f"{s}_{v}": F.coalesce(F.col(f"{s}_{v}"), F.lit(0)) for v in values for s in "bc"})
    return both.withColumns({f"d_{v}": F.round(F.col(f"c_{v}") - F.col(f"b_{v}"), 6) for v in values})


def trend(delta):
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")


def metric(values: DataFrame, windows: DataFrame) -> DataFrame:
    """Value, change, ratio (null to a base of 0) and trend per metric, with the reasons for which either trace is untrusted."""
    o = outer(values, ["metric_id"], ["value"])
    told = o.withColumns({"ratio": F.when(F.col("b_value") != 0, F.round(F.col("c_value") / F.col("b_value"), 6)), "trend": trend(F.col("d_value"))})
    codes = windows.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("reason_code")), ",").alias("codes"))
    for side, df in zip("bc", sides(codes), strict=True):
        told = told.join(df.select("pair", F.col("codes").alias(f"{side}_reason_codes")), "pair", "left")
    return told


def alert_change(alerts: DataFrame) -> DataFrame:
    o = outer(alerts.groupBy("dataset_id", "type", "severity").agg(F.count("*").alias("n")), ["type", "severity"], ["n"])
    return o.withColumns({"added": F.greatest("d_n", F.lit(0)), "removed": F.greatest(-F.col("d_n"), F.lit(0))})


def top_changes(o: DataFrame, delta: str, ident: str, k: int = 10) -> DataFrame:
    """The k largest changes of each pair."""
    big = F.greatest(F.col(delta.replace("d_", "b_")), F.col(delta.replace("d_", "c_")))
    w = W.partitionBy("pair").orderBy(F.desc(F.abs(delta)), F.desc(big), ident)
    return o.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hotspot(counts: DataFrame, k: int = 10) -> DataFrame:
    """Counts on the union of both sides' k most frequent nodes."""
    w = W.partitionBy("dataset_id").orderBy(F.desc("n"), "node")
    hot = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    named = hot.select(F.floor(F.col("dataset_id").cast("long") / 2).alias("pair"), "node").distinct()
    return top_changes(outer(counts, ["node"], ["n"]).join(named, ["pair", "node"], "left_semi"), "d_n", "node", k)


def longest_block(states: DataFrame) -> DataFrame:
    longest = states.where("state = 'BLOCKED'").groupBy("dataset_id").agg(F.max(F.col("t_end") - F.col("t_begin")).alias("longest"))
    return outer(longest, [], ["longest"])


def _length():
    return F.col("t_end") - F.col("t_begin")


def task(slices: DataFrame, states: DataFrame) -> DataFrame:
    run = slices.groupBy("dataset_id", "task_id").agg(F.sum(_length()).alias("runtime"))
    blocked = states.where("state = 'BLOCKED'").groupBy("dataset_id", "task_id").agg(F.sum(_length()).alias("blocked"))
    return outer(run.join(blocked, ["dataset_id", "task_id"], "full"), ["task_id"], ["runtime", "blocked"])


def core(slices: DataFrame, events: DataFrame) -> DataFrame:
    run = slices.groupBy("dataset_id", "core_id").agg(F.sum(_length()).alias("runtime"))
    switches = events.where("event_name = 'CTX_SWITCH'").groupBy("dataset_id", "core_id").agg(F.count("*").alias("switches"))
    return outer(run.join(switches, ["dataset_id", "core_id"], "full"), ["core_id"], ["runtime", "switches"])


def resource(events: DataFrame, states: DataFrame) -> DataFrame:
    n = events.where("obj_id is not null").groupBy("dataset_id", "obj_id").agg(F.count("*").alias("events"))
    blocked = states.where("state = 'BLOCKED' and related_obj is not null").groupBy("dataset_id", F.col("related_obj").alias("obj_id")).agg(F.sum(_length()).alias("blocked"))
    return outer(n.join(blocked, ["dataset_id", "obj_id"], "full"), ["obj_id"], ["events", "blocked"])


def irq(irqs: DataFrame) -> DataFrame:
    return outer(irqs.groupBy("dataset_id", "irq_id").agg(F.sum(_length()).alias("busy"), F.count("*").alias("spans")), ["irq_id"], ["busy", "spans"])


def detail_rows(t, alerts: DataFrame, hotspots: DataFrame) -> DataFrame:
    """dataset_id, dimension, key, ref, t_begin, t_end, evidence: what can be shown for each of the eight dimensions.

    Metrics show the intervals they add up, alerts themselves, hotspots (dataset_id, node) their
    events, the interval dimension the blocked segments of the trace, tasks and resources theirs, cores slices, interrupts spans.
    """
    blocked, ready = t.states.where("state = 'BLOCKED'"), t.states.where("state = 'READY'")
    lit = F.lit

    def pick(df, dimension, key, ref, *evidence):
        span = ["t_begin", "t_end"] if "t_begin" in df.columns else [F.col("ts").alias("t_begin"), F.col("ts").alias("t_end")]
        events = F.array_distinct(F.array_compact(F.array(*evidence)))
        return df.where(key.isNotNull()).select("dataset_id", lit(dimension).alias("dimension"), key.cast("string").alias("key"), F.col(ref).alias("ref"), *span, events.alias("evidence"))

    slices, spans = ("start_event", "end_event"), ("enter_event", "exit_event")
    nodes = F.explode(F.array_compact(F.array(F.concat(lit("task:"), F.col("task_id").cast("string")), F.concat(lit("obj:"), F.col("obj_id").cast("string")))))
    hot = t.events.select("dataset_id", "event_uid", "ts", nodes.alias("node")).join(hotspots.select("dataset_id", "node"), ["dataset_id", "node"], "left_semi")
    parts = [
        pick(t.slices, "metric", lit("cpu_utilization"), "slice_id", *slices), pick(blocked, "metric", lit("blocked_time"), "seg_id", "cause_event"), pick(ready, "metric", lit("ready_wait_time"), "seg_id", "cause_event"),
        pick(t.irqs, "metric", lit("irq_busy_time"), "irq_span_id", *spans), pick(t.irqs.where("delayed_task is not null"), "metric", lit("irq_latency"), "irq_span_id", *spans),
        pick(t.events.where("event_name = 'CTX_SWITCH'"), "metric", lit("context_switch_count"), "event_uid", "event_uid"),
        pick(alerts, "alert", F.col("type"), "alert_id", "evidence"), pick(hot, "hotspot", F.col("node"), "event_uid", "event_uid"), pick(blocked, "interval", lit("max_blocked"), "seg_id", "cause_event"),
        pick(blocked, "task", F.col("task_id"), "seg_id", "cause_event"), pick(blocked, "resource", F.col("related_obj"), "seg_id", "cause_event"),
        pick(t.slices, "core", F.col("core_id"), "slice_id", *slices), pick(t.irqs, "irq", F.col("irq_id"), "irq_span_id", *spans),
    ]
    return reduce(DataFrame.unionByName, parts)


def diff_detail(rows: DataFrame, k: int = 3, margin: int = 20) -> DataFrame:
    """Per dimension, key and pair: the k longest rows of either side as samples, their time in all, the events that they rest on (each once), and the window to jump to."""
    s = rows.withColumn("length", _length())
    w = W.partitionBy("dataset_id", "dimension", "key").orderBy(F.desc("length"), "t_begin", "ref")
    top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    g = top.groupBy("dataset_id", "dimension", "key").agg(
        F.sum("length").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"]), ",").alias("samples"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), ",").alias("refs"),
        F.greatest(F.lit(0), F.min("t_begin") - margin).alias("jump_begin"), (F.max("t_end") + margin).alias("jump_end"),
    )
    base, cand = sides(g)
    names, by = ("total", "samples", "refs", "jump_begin", "jump_end"), ["pair", "dimension", "key"]
    return base.select(*by, *[F.col(c).alias(f"b_{c}") for c in names]).join(cand.select(*by, *[F.col(c).alias(f"c_{c}") for c in names]), by, "full")


def field_drift(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field differences of two tables of flat records: missing, unexpected, or how they differ."""
    long = lambda df: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*").where("value is not null")
    j = long(expected).withColumnRenamed("value", "expected").join(long(actual).withColumnRenamed("value", "actual"), [key, "field"], "full")
    kind = (
        F.when(F.col("expected").isNull(), "UNEXPECTED_ACTUAL_FIELD")
        .when(F.col("actual").isNull(), "MISSING_ACTUAL_FIELD")
        .when(F.col("field").endswith("count"), "COUNT_MISMATCH")
        .when(F.col("field").endswith("timestamp"), "TIMESTAMP_MISMATCH")
        .otherwise("VALUE_MISMATCH")
    )
    return j.where("not (expected <=> actual)").withColumn("mismatch", kind)


def fact_drift(frozen: DataFrame, again: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields whose digests differ between two reports of the same key."""
    digest = lambda f: F.sha2(F.coalesce(F.col(f).cast("string"), F.lit("null")), 256)
    one, two = (df.select(key, *[digest(f).alias(f"{p}_{f}") for f in fields]) for df, p in ((frozen, "x"), (again, "y")))
    j = one.join(two, key)
    return j.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(f"x_{f}") != F.col(f"y_{f}"), f) for f in fields]))).alias("drifted"))


def replay_invariants(events: DataFrame) -> DataFrame:
    """Per dataset: first and last timestamp, count, and how often time steps back within a core."""
    w = W.partitionBy("dataset_id", "core_id").orderBy("seq")
    e = events.withColumn("back", F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False)))
    return e.groupBy("dataset_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.count_if("back").alias("regressions"))
