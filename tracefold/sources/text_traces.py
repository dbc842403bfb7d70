"""Readers of foreign trace formats: text lines in, typed rows out, rejects with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import int_of

EVENT_SCHEMA = T.StructType(
    [T.StructField("core_id", T.IntegerType()), T.StructField("event_name", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("timestamp", T.LongType())]
    + [T.StructField("payload", T.StructType([T.StructField(n, T.LongType()) for n in ("task_id", "prev_task_id", "next_task_id", "obj_id", "irq_id", "job_id", "deadline_ts")] + [T.StructField("reason", T.StringType())]))]
)
#: Fixed values of the BTF format.
BTF_KINDS = {"C": ("set_frequence",), "T": ("activate", "start", "preempt", "resume", "terminate", "wait", "release"), "STI": ("trigger",)}


def scan_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Event rows as JSON lines, with an explicit schema."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line. A file is one row here, as its lines depend on the ones before."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return whole.where("line <> ''").select("file", (F.col("n") + 1).alias("line_no"), "line")


def scan_btf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of comma-separated BTF lines: time, subject, instance, kind, target, instance, action, detail."""
    lines = spark.read.text(path).where("not startswith(value, '#') and value <> ''").withColumn("f", F.split("value", ","))
    f = lambda i: F.trim(F.get("f", F.lit(i)))
    allowed = F.lit(False)
    for kind, actions in BTF_KINDS.items():
        allowed = allowed | ((f(3) == kind) & f(6).isin(*actions))
    why = F.when(F.size("f") != 8, "FIELD_COUNT").when(int_of(f(0)).isNull(), "TIMESTAMP").when(~f(3).isin(*BTF_KINDS), "KIND").when(~allowed, "ACTION")
    typed = lines.withColumn("reason", why)
    rows = typed.where("reason is null").select(int_of(f(0)).alias("timestamp"), f(1).alias("subject"), f(3).alias("kind"), f(4).alias("target"), f(6).alias("action"), f(7).alias("detail"))
    return rows, typed.where("reason is not null").select("value", "reason")


def scan_vcd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(value changes, problems) of scalar dumps: a ``#time`` line holds for the lines after it."""
    lines = numbered_lines(spark, path)
    order = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    stamp = F.when(F.col("line").rlike("^#[0-9]+$"), F.substring("line", 2, 30).cast("long"))
    t = lines.withColumn("stamp", stamp).withColumns({"timestamp": F.last("stamp", True).over(order), "latest": F.max("stamp").over(order)})
    ids = lines.where("line like '$var %'").select("file", F.regexp_extract("line", r"^\$var\s+\w+\s+1\s+(\S+)\s", 1).alias("identifier"))
    change = t.where(t.line.rlike("^[01xXzZ][^\\s]+$"))
    change = change.select("file", "line_no", "timestamp", "latest", F.substring("line", 1, 1).alias("bit"), F.substring("line", 2, 100).alias("identifier"))
    good = change.where("bit in ('0', '1')").join(ids, ["file", "identifier"], "left_semi").select("file", "line_no", "timestamp", "identifier", F.col("bit").cast("int").alias("value"))
    back = t.where("stamp < latest").select("file", "line_no", F.lit("TIMESTAMP_REGRESSION").alias("reason"))
    odd = change.where("bit not in ('0', '1')").select("file", "line_no", F.lit("UNSUPPORTED_VALUE").alias("reason"))
    return good, back.unionByName(odd)


def scan_systrace(spark: SparkSession, path: str) -> DataFrame:
    """``name-tid [cpu] seconds: payload`` lines; time in ns, exact from its digits."""
    pattern = r"^\s*(.+)-(\d+)\s+\[(\d+)\]\s+(?:\S+\s+)?(\d+)\.(\d+):\s+(.*)$"
    p = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(p(1).alias("task_name"), p(2).cast("long").alias("tid"), p(3).cast("int").alias("cpu"), (p(4).cast("long") * 1_000_000_000 + F.rpad(p(5), 9, "0").cast("long")).alias("timestamp_ns"), p(6).alias("payload"))


CLUSTER_SCHEMA = "collection_id long, instance_index int, machine_id long, type int, priority int, time long, missing_type int"


def scan_cluster_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTER_SCHEMA).json(path)


def scan_logic_csv(spark: SparkSession, path: str, channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows where a watched channel changes, rising edges of the first channel), ordered by time within a file."""
    schema = ", ".join(["time double", *[f"{c} int" for c in channels]])
    rows = spark.read.schema(schema).csv(path, comment=";", header=True, enforceSchema=True).withColumn("file", F.col("_metadata.file_path"))
    w = W.partitionBy("file").orderBy("time")
    r = rows.withColumns({f"_{c}": F.lag(c).over(w) for c in channels})
    changed = F.lit(False)
    for c in channels:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    edges = r.where((F.col(channels[0]) == 1) & (F.col(f"_{channels[0]}") == 0)).select("file", "time")
    return r.where(changed).select("file", "time", *channels), edges


def scan_telemetry(spark: SparkSession, path: str, names: list[str], only: dict[str, list[str]] | None = None, last: int | None = None) -> DataFrame:
    """Run metrics as JSON lines, flat or nested under ``metrics`` or ``telemetry_record``.

    only: allowed values by column (dataset_id, mode, family, run_id); last: so many
    of the latest rows of each dataset (ties to the smaller run_id).
    """
    fields = ", ".join(f"{n}: double" for n in names)
    schema = f"run_id string, dataset_id string, mode string, family string, at long, metrics struct<{fields}>, telemetry_record struct<{fields}>, " + ", ".join(f"{n} double" for n in names)
    rows = spark.read.schema(schema).json(path)
    out = rows.select("run_id", "dataset_id", "mode", "family", "at", *[F.coalesce(f"metrics.{n}", f"telemetry_record.{n}", n).alias(n) for n in names])
    for column, values in (only or {}).items():
        out = out.where(F.col(column).isin(values))
    if last is not None:
        place = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("at"), "run_id"))
        out = out.withColumn("place", place).where(F.col("place") <= last).drop("place")
    return out
