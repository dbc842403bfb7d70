"""Windowed metrics over the interval tables. ``scope`` has one analysis window per dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import round6
from ..functions.quantiles import exact_quantiles
from .filters import clipped, in_window
from .intervals import overlap_buckets

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def duration():
    return F.greatest(F.col("w_end") - F.col("w_begin"), F.lit(1))


def cpu_utilization(slices: DataFrame, scope: DataFrame) -> DataFrame:
    s = clipped(slices, scope).groupBy("dataset_id", "core_id", "w_begin", "w_end").agg(F.sum("clipped").alias("run_time"))
    return s.select("dataset_id", "core_id", "run_time", round6(F.col("run_time") / duration()).alias("utilization"))


def cpu_summary(slices: DataFrame, scope: DataFrame) -> DataFrame:
    """avg_utilization is the cores' sum, not their mean."""
    s = clipped(slices, scope).groupBy("dataset_id", "w_begin", "w_end").agg(F.sum("clipped").alias("total_run_time"), F.count_distinct("core_id").alias("core_count"))
    return s.select("dataset_id", "total_run_time", "core_count", round6(F.col("total_run_time") / duration()).alias("avg_utilization"))


def ranked(df: DataFrame, by: str, ident: str, k: int = 10, keys: tuple = ("dataset_id",)) -> DataFrame:
    """The k largest of each key, ties to the smaller id."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), ident)))
    return out.where(F.col("rank") <= k)


def state_time(states: DataFrame, scope: DataFrame, state: str) -> DataFrame:
    """Per task: total and longest clipped time in a state."""
    s = clipped(states.where(F.col("state") == state), scope)
    return s.groupBy("dataset_id", "task_id").agg(F.sum("clipped").alias("total"), F.max("clipped").alias("longest"), F.count("*").alias("segments"))


def response_samples(states: DataFrame, scope: DataFrame) -> DataFrame:
    """READY segments followed at once by RUNNING of the same task, within the window; the unclipped length."""
    order = W.partitionBy("dataset_id", "task_id").orderBy("t_begin", "t_end", "seg_id")
    s = in_window(states, scope).withColumn("after", F.lead("state").over(order))
    return s.where("state = 'READY' and after = 'RUNNING'").select("dataset_id", "task_id", "seg_id", "t_end", (F.col("t_end") - F.col("t_begin")).alias("response"))


def response_time(states: DataFrame, scope: DataFrame) -> DataFrame:
    return response_samples(states, scope).groupBy("dataset_id", "task_id").agg(round6(F.avg("response")).alias("avg_response"), F.max("response").alias("max_response"), F.count("*").alias("samples"))


def response_jitter(states: DataFrame, scope: DataFrame) -> DataFrame:
    return response_samples(states, scope).groupBy("dataset_id", "task_id").agg((F.max("response") - F.min("response")).alias("jitter"))


def deadline_records(events: DataFrame, scope: DataFrame) -> DataFrame:
    """One row per job (or, without one, task): its last accepted release and the first exit after it.

    Without a job, a READY is accepted only if the task's row before it (READY
    or EXIT without a job) isn't a READY; the others are conflicts.
    """
    e = in_window(events, scope).where("event_name = 'TASK_EXIT' or event_name = 'TASK_READY' and deadline_ts is not null")
    key = W.partitionBy("dataset_id", "task_id", "job_id").orderBy("ts", "core_id", "seq")
    ready = F.col("event_name") == "TASK_READY"
    e = e.withColumns({"i": F.row_number().over(key), "before": F.lag("event_name").over(key)})
    e = e.withColumn("accepted", ready & (F.col("job_id").isNotNull() | ~F.coalesce(F.col("before") == "TASK_READY", F.lit(False))))
    e = e.withColumn("last_ready", F.max(F.when(F.col("accepted"), F.col("i"))).over(W.partitionBy("dataset_id", "task_id", "job_id")))
    r = e.groupBy("dataset_id", "task_id", "job_id").agg(
        F.max(F.when(F.col("i") == F.col("last_ready"), F.col("ts"))).alias("release_ts"),
        F.max(F.when(F.col("i") == F.col("last_ready"), F.col("deadline_ts"))).alias("deadline_ts"),
        F.max(F.when(F.col("i") == F.col("last_ready"), F.col("event_uid"))).alias("release_event"),
        F.min(F.when(~ready & (F.col("i") > F.col("last_ready")), F.struct("i", "ts"))).alias("finish"),
        F.count_if(ready & ~F.col("accepted")).alias("conflicts"),
        F.max("last_ready").alias("n"),
    ).where("n is not null")
    finish = F.col("finish.ts")
    return r.select(
        "dataset_id",
        "task_id",
        "job_id",
        F.when(F.col("job_id").isNull(), "degraded").otherwise("precise").alias("semantics"),
        "release_ts",
        "deadline_ts",
        finish.alias("finish_ts"),
        F.greatest(F.lit(0).cast("long"), finish - F.col("release_ts")).alias("response_time"),
        F.greatest(F.lit(0).cast("long"), finish - F.col("deadline_ts")).alias("deadline_miss"),
        "conflicts",
        "release_event",
    )


def _null_if_open(df: DataFrame) -> DataFrame:
    done = F.col("finish_ts").isNotNull()
    return df.withColumns({c: F.when(done, F.col(c)) for c in ("response_time", "deadline_miss")})


def deadline_analysis(events: DataFrame, scope: DataFrame) -> DataFrame:
    return _null_if_open(deadline_records(events, scope))


def deadline_status(events: DataFrame, scope: DataFrame) -> DataFrame:
    """Per dataset: miss_count, max_miss, records, incomplete, conflicts, semantics_status."""
    d = deadline_analysis(events, scope)
    a = d.groupBy("dataset_id").agg(
        F.count_if(F.col("deadline_miss") > 0).alias("miss_count"),
        F.coalesce(F.max("deadline_miss"), F.lit(0)).alias("max_miss"),
        F.count("finish_ts").alias("records"),
        F.count_if(F.col("finish_ts").isNull()).alias("incomplete"),
        F.sum("conflicts").alias("conflicts"),
        F.count_if(F.col("finish_ts").isNotNull() & (F.col("semantics") != "precise")).alias("imprecise"),
    )
    status = F.when((F.col("records") > 0) & (F.col("incomplete") + F.col("conflicts") + F.col("imprecise") == 0), "precise").when(F.col("records") + F.col("incomplete") + F.col("conflicts") > 0, "degraded").otherwise("unsupported")
    return a.select("dataset_id", "miss_count", "max_miss", "records", "incomplete", "conflicts", status.alias("semantics_status"))


def context_switches(events: DataFrame, scope: DataFrame) -> DataFrame:
    return in_window(events, scope).groupBy("dataset_id").agg(F.count_if(F.col("event_name") == "CTX_SWITCH").alias("switches"))


def irq_busy(irqs: DataFrame, scope: DataFrame) -> DataFrame:
    return clipped(irqs, scope).groupBy("dataset_id", "core_id").agg(F.sum("clipped").alias("busy_time"), F.count("*").alias("irq_count"))


def irq_latency(irqs: DataFrame, scope: DataFrame) -> DataFrame:
    s = clipped(irqs, scope).where("delayed_task is not null")
    return s.groupBy("dataset_id", "delayed_task").agg(F.sum("clipped").alias("total_latency"), F.max("clipped").alias("max_latency"), F.count("*").alias("spans"))


def quantiles(df: DataFrame, column: str, keys: tuple = ("dataset_id",)) -> DataFrame:
    """Interpolated p50, p90, p95 and p99, and the count."""
    names = {f"p{int(p * 100)}": p for p in QUANTILES}
    return exact_quantiles(df, list(keys), column, names).select(*keys, *[round6(F.col(c)).alias(c) for c in names], "n")


def metric_values(t, scope: DataFrame) -> DataFrame:
    """One number per metric and dataset; each table is cut to the scope and grouped once for all of its metrics."""
    ds = "dataset_id"
    state, delayed = F.col("state"), F.col("delayed_task").isNotNull()
    waited = clipped(t.states.where("state in ('BLOCKED', 'READY')"), scope).groupBy(ds).agg(*[F.sum(F.when(state == s, F.col("clipped"))).cast("double").alias(n) for s, n in (("BLOCKED", "blocked_time"), ("READY", "ready_wait_time"))])
    # sums stay whole numbers until the one division
    tasks = response_samples(t.states, scope).groupBy(ds, "task_id").agg(F.sum("response").alias("s"), F.count("*").alias("k"), (F.max("response") - F.min("response")).alias("j"))
    answers = tasks.groupBy(ds).agg(round6(F.sum("s") / F.sum("k")).alias("response_time"), F.max("j").cast("double").alias("response_jitter"))
    busy = clipped(t.irqs, scope).groupBy(ds).agg(F.sum("clipped").cast("double").alias("irq_busy_time"), F.sum(F.when(delayed, F.col("clipped"))).cast("double").alias("irq_latency"))
    parts = [
        cpu_summary(t.slices, scope).select(ds, F.col("avg_utilization").alias("cpu_utilization")),
        waited,
        answers,
        deadline_status(t.events, scope).select(ds, F.col("max_miss").cast("double").alias("deadline_miss")),
        context_switches(t.events, scope).select(ds, F.col("switches").cast("double").alias("context_switch_count")),
        busy,
    ]
    # a trace without rows of a metric has none
    told = [df.select(ds, F.explode(F.array(*[F.struct(F.col(c).alias("value"), F.lit(c).alias("metric_id")) for c in df.columns if c != ds])).alias("m")).select(ds, "m.*").where("value is not null") for df in parts]
    return reduce(DataFrame.unionByName, told)


def bucket_count(lod: int) -> int:
    return max(6, min(24, lod * 6))


def bucket_series(t, scope: DataFrame, lod: int = 2) -> DataFrame:
    """dataset_id, bucket, metric_id, value: every metric per tumbling bucket of the scope, in one pass over each table.

    Times are those inside the bucket. A response belongs to the bucket in
    which it ends, a deadline to that of the job's finish.
    """
    n = bucket_count(lod)
    kinds = [
        (t.slices, "cpu_utilization", F.lit(True)),
        (t.states, "blocked_time", F.col("state") == "BLOCKED"),
        (t.states, "ready_wait_time", F.col("state") == "READY"),
        (t.irqs, "irq_busy_time", F.lit(True)),
        (t.irqs, "irq_latency", F.col("delayed_task").isNotNull()),
    ]
    timed = reduce(DataFrame.unionByName, [df.where(ok).select("dataset_id", "t_begin", "t_end", F.lit(m).alias("metric_id")) for df, m, ok in kinds])
    inside = overlap_buckets(timed.where("t_end > t_begin").withColumn("length", F.col("t_end") - F.col("t_begin")), scope, n, "length")
    size = F.greatest((F.col("w_end") - F.col("w_begin")) / n, F.lit(1.0))
    times = inside.groupBy("dataset_id", "bucket", "metric_id", "w_begin", "w_end").agg(F.sum("part").alias("x"))
    times = times.select("dataset_id", "bucket", "metric_id", F.when(F.col("metric_id") == "cpu_utilization", round6(F.col("x") / size)).otherwise(F.round("x", 2)).alias("value"))

    def placed(df: DataFrame, at: str) -> DataFrame:
        place = F.least(F.lit(n - 1), F.floor((F.col(at) - F.col("w_begin")) / size)).cast("int")
        return df.withColumn("bucket", place)

    switches = placed(in_window(t.events, scope).where("event_name = 'CTX_SWITCH'"), "ts").groupBy("dataset_id", "bucket").agg(F.count("*").cast("double").alias("value")).withColumn("metric_id", F.lit("context_switch_count"))
    per_task = placed(response_samples(t.states, scope).join(scope, "dataset_id"), "t_end").groupBy("dataset_id", "bucket", "task_id").agg(F.sum("response").alias("s"), F.count("*").alias("k"), (F.max("response") - F.min("response")).alias("j"))
    both = per_task.groupBy("dataset_id", "bucket").agg(F.round(F.sum("s") / F.sum("k"), 3).alias("response_time"), F.max("j").cast("double").alias("response_jitter"))
    answers = both.unpivot(["dataset_id", "bucket"], ["response_time", "response_jitter"], "metric_id", "value")
    missed = placed(deadline_analysis(t.events, scope).where("finish_ts is not null").join(scope, "dataset_id"), "finish_ts").groupBy("dataset_id", "bucket").agg(F.max("deadline_miss").cast("double").alias("value")).withColumn("metric_id", F.lit("deadline_miss"))
    return reduce(DataFrame.unionByName, [times, switches, answers, missed])


def trust_summary(windows: DataFrame, scope: DataFrame) -> DataFrame:
    return in_window(windows, scope).groupBy("dataset_id", "reason_code").agg(F.count("*").alias("n"))
