"""Clock alignment of the cores of each dataset from calibration anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ts", "core_id", "seq")


def core_alignment(events: DataFrame) -> DataFrame:
    """Per (dataset, core): first anchor, offset to the smallest core, and whether the dataset is calibrated.

    Calibrated means more than one core, each with an anchor.
    """
    anchor = F.when(F.col("event_name").isin("SYNC_CALIB", "TS_CALIB"), F.col("ts_raw"))
    cores = events.groupBy("dataset_id", "core_id").agg(F.min(anchor).alias("anchor"), F.max("ts_raw").alias("last_raw"))
    datasets = cores.groupBy("dataset_id").agg(
        F.count("*").alias("n_cores"), (F.count("*") == F.count("anchor")).alias("anchored"), F.min_by("anchor", "core_id").alias("ref_anchor"), F.min("core_id").alias("ref_core")
    )
    both = cores.join(datasets, "dataset_id")
    return both.select("dataset_id", "core_id", "anchor", (F.col("ref_anchor") - F.col("anchor")).alias("offset"), "n_cores", (F.col("anchored") & (F.col("n_cores") > 1)).alias("calibrated"))


def align(events: DataFrame) -> DataFrame:
    """Adds ts (aligned) and covered: raw + offset from the core's own anchor on, raw elsewhere."""
    cores = core_alignment(events).select("dataset_id", "core_id", "anchor", "offset", "n_cores", "calibrated")
    e = events.join(cores, ["dataset_id", "core_id"])
    inside = F.col("calibrated") & (F.col("ts_raw") >= F.col("anchor"))
    e = e.withColumns({"ts": F.when(inside, F.col("ts_raw") + F.col("offset")).otherwise(F.col("ts_raw")), "covered": (F.col("n_cores") == 1) | F.coalesce(inside, F.lit(False))})
    return e.drop("anchor", "offset", "n_cores", "calibrated")


def degraded_windows(aligned: DataFrame) -> DataFrame:
    """One ALIGN_DEGRADED window per dataset with uncovered events."""
    span = aligned.where("not covered").groupBy("dataset_id").agg(F.min("ts_raw").alias("t_begin"), F.max("ts_raw").alias("t_end"))
    return span.select(
        "dataset_id",
        F.concat(F.lit("uw:"), "dataset_id", F.lit(":align")).alias("window_id"),
        F.lit("align").alias("source"),
        F.lit("dataset").alias("scope"),
        "t_begin",
        "t_end",
        F.lit("ALIGN_DEGRADED").alias("reason_code"),
        F.lit("warning").alias("severity"),
    )


def dedupe_observations(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["event_uid", "ts"])


SQL = {
    "cores": """SELECT dataset_id, core_id, min(ts_raw) FILTER (WHERE event_name IN ('SYNC_CALIB', 'TS_CALIB')) AS anchor FROM tagged GROUP BY ALL""",
    "cal": """SELECT dataset_id, core_id, anchor, first_value(anchor) OVER (PARTITION BY dataset_id ORDER BY core_id) - anchor AS "offset", count(*) OVER d AS n_cores,
  count(*) OVER d = count(anchor) OVER d AND count(*) OVER d > 1 AS calibrated FROM cores WINDOW d AS (PARTITION BY dataset_id)""",
    "al": """SELECT e.*, CASE WHEN calibrated AND ts_raw >= anchor THEN ts_raw + "offset" ELSE ts_raw END AS ts, n_cores = 1 OR coalesce(calibrated AND ts_raw >= anchor, false) AS covered
  FROM tagged AS e JOIN cal USING (dataset_id, core_id)""",
    "align_windows": """SELECT dataset_id, 'uw:' || dataset_id || ':align' AS window_id, 'align' AS source, 'dataset' AS scope, min(ts_raw) AS t_begin, max(ts_raw) AS t_end,
  'ALIGN_DEGRADED' AS reason_code, 'warning' AS severity FROM al WHERE NOT covered GROUP BY dataset_id""",
}
