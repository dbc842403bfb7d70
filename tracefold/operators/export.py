"""Packages: full and clipped exports, reference indexes, and derived traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .filters import graph_filter, in_window, scope_filter

TABLES = ("events", "states", "slices", "holds", "waits", "irqs", "windows")


def export_full(t, path: str, more: dict[str, DataFrame] | None = None) -> None:
    """One Parquet table each, whose files are sorted by dataset so that readers of one trace skip the pages of others. more: further tables with a dataset_id, such as metrics, alerts, diagnoses, anchors.

    A folder a dataset would give every task a file for each of its traces.
    """
    for name, df in [*((n, getattr(t, n)) for n in TABLES), *(more or {}).items()]:
        df.sortWithinPartitions("dataset_id").write.mode("overwrite").parquet(f"{path}/{name}")


def scan_package(spark: SparkSession, path: str, more: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of a package."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*TABLES, *more)}


def manifest(package: dict[str, DataFrame], checksums: bool = False) -> DataFrame:
    """dataset_id, table, rows; if asked also a checksum that doesn't depend on the order of rows."""

    def told(name: str, df: DataFrame) -> DataFrame:
        sums = [F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("checksum")] if checksums else []
        return df.groupBy("dataset_id").agg(F.count("*").alias("rows"), *sums).withColumn("table", F.lit(name))

    return reduce(DataFrame.unionByName, [told(n, df) for n, df in package.items()])


def clip(t, scope: DataFrame, spec: dict | None = None) -> dict[str, DataFrame]:
    """All tables cut to the scope and to a filter (task_id, core_id, event_name, obj_id, irq_id), which edges meet by either of their tasks; windows that a kept object touches stay even when outside."""
    kept = {name: in_window(getattr(t, name), scope).drop("w_begin", "w_end") for name in TABLES if name != "windows"}
    if spec:
        task, obj = spec.get("task_id"), spec.get("obj_id", spec.get("resource_id"))
        rest = {k: v for k, v in spec.items() if k not in ("task_id", "obj_id", "resource_id")}
        kept = {name: scope_filter(graph_filter(df, task, obj), rest) if name in ("holds", "waits") else scope_filter(df, spec) for name, df in kept.items()}
    inside = in_window(t.windows, scope).drop("w_begin", "w_end")
    edges = kept["holds"].unionByName(kept["waits"]).where("reason_code is not null").select("dataset_id", F.concat_ws(":", F.lit("uw"), "dataset_id", "reason_code", "evidence_ref").alias("window_id"))
    needed = t.windows.join(edges, ["dataset_id", "window_id"], "left_semi").select(*inside.columns)
    return kept | {"windows": inside.unionByName(needed).dropDuplicates(["dataset_id", "window_id"])}


def ref_index(events: DataFrame) -> DataFrame:
    return events.select("dataset_id", F.col("event_uid").alias("ref_key"), "ts", "core_id", "seq")


#: What mentions events in a table, by category.
MENTIONS = {
    "states": ("cause_event",), "slices": ("start_event", "end_event"), "holds": ("evidence_ref", "end_event"), "waits": ("evidence_ref", "end_event"),
    "irqs": ("enter_event", "exit_event"), "alerts": ("evidence",), "diagnoses": ("evidence",), "anchors": ("ref",), "contexts": ("ref",),
}


def refs_by_category(package: dict[str, DataFrame]) -> DataFrame:
    """dataset_id, category, ref_key of every event that a table of the package mentions; of alerts, diagnoses and marks only events count."""
    one = lambda name: package[name].select("dataset_id", F.lit(name).alias("category"), F.explode(F.array_compact(F.array(*MENTIONS[name]))).alias("ref_key"))
    return reduce(DataFrame.unionByName, [one(n) for n in MENTIONS if n in package]).where("startswith(ref_key, 'evt:')").distinct()


def required_refs(package: dict[str, DataFrame]) -> DataFrame:
    """Every event that a table of the package mentions."""
    return refs_by_category(package).select("dataset_id", "ref_key").distinct()


def missing_refs(package: dict[str, DataFrame], by_category: bool = False) -> DataFrame:
    """References of the package that its events don't have."""
    refs = refs_by_category(package) if by_category else required_refs(package)
    return refs.join(ref_index(package["events"]), ["dataset_id", "ref_key"], "left_anti")


def metric_rows(values: DataFrame) -> DataFrame:
    """dataset_id, metrics: a trace's metrics as one JSON object, by name, with six decimals."""
    pair = F.concat(F.lit('"'), "metric_id", F.lit('":'), F.format_string("%.6f", "value"))
    sorted_ = F.array_sort(F.collect_list(F.struct("metric_id", pair.alias("pair"))))
    return values.where("value is not null").groupBy("dataset_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(sorted_, lambda m: m["pair"]), ","), F.lit("}")).alias("metrics"))


def merge_segments(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scale_up(events: DataFrame, times: int) -> DataFrame:
    """A trace repeated: each copy's sequence numbers and times follow on the one before."""
    cores = events.groupBy("dataset_id", "core_id").agg(F.max("seq").alias("max_seq"))
    spans = events.groupBy("dataset_id").agg((F.max("ts_raw") - F.min("ts_raw") + 1).alias("cycle"))
    e = events.join(cores, ["dataset_id", "core_id"]).join(spans, "dataset_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return e.withColumns({"seq": F.col("seq") + F.col("copy") * F.col("max_seq"), "ts_raw": F.col("ts_raw") + F.col("copy") * F.col("cycle")}).drop("max_seq", "cycle")


def perturb(events: DataFrame, stride: int = 17, shift: int = 37) -> DataFrame:
    """A candidate trace: of every ``stride`` events of a core one has its reason or priority changed, the others are shifted in time."""
    n = F.row_number().over(W.partitionBy("dataset_id", "core_id").orderBy("seq")) % stride == 1
    e = events.withColumn("_hit", n)
    hit = F.col("_hit")
    return e.withColumns({"reason": F.when(hit, F.col("reason") + 1).otherwise(F.col("reason")), "prio": F.when(hit & F.col("reason").isNull(), F.col("prio") + 1).otherwise(F.col("prio")), "ts_raw": F.when(hit, F.col("ts_raw")).otherwise(F.col("ts_raw") + shift)}).drop("_hit")
