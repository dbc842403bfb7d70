"""The ``events`` table of the test data seen as scheduler-trace events.

A fixed integer mapping: one dataset per 2000 events (or as many as asked), four cores, six tasks,
four objects. One event in 97 is left out after numbering, so that sequences
have gaps. ``nested`` interrupts run to three levels, over and over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import scan

DATASET_EVENTS = 2000
DROPPED = 97
KINDS = ("TASK_READY", "TASK_BLOCK", "TASK_WAKEUP", "TASK_DISPATCH", "CTX_SWITCH", "SYNC_LOCK", "SYNC_UNLOCK", "IRQ_ENTER", "IRQ_EXIT", "CTX_SWITCH", "TASK_EXIT")


def trace_events(spark: SparkSession, sf_dir: str, dataset_events: int = DATASET_EVENTS, nested: bool = False, long: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(
        F.expr(f"cast(event_id div {dataset_events} as string)").alias("dataset_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_raw"),
        F.expr("cast(event_id div 12 % 4 as int)").alias("core_id"),
        (F.col("event_id") % 12).alias("kind"),
        F.expr("event_id div 12").alias("j"),
        (F.col("user_id") % 6 + 1).alias("t"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    )
    late = F.expr("element_at(array(if(core_id = 0, 'SYNC_CALIB', 'TS_CALIB'), 'LOSS', 'OVERFLOW', 'SYNC_TRY'), cast(j div 4 % 4 as int) + 1)")
    e = scan(e, ["dataset_id", "core_id"], ["ts_raw", "event_id"], number="seq", long=long).withColumn("seq", F.col("seq").cast("long"))
    e = e.withColumn("event_name", F.coalesce(F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("kind")), late))
    irq, depth = F.col("kind").isin(7, 8), F.lit(1)
    if nested:  # of four pairs of a core the first enters two levels, the last leaves them, and those between use the third
        turn = F.expr("j div 4 % 4")
        e = e.withColumn("event_name", F.when(irq & (turn == 0), "IRQ_ENTER").when(irq & (turn == 3), "IRQ_EXIT").otherwise(F.col("event_name")))
        depth = F.when(turn.isin(1, 2), 3).when((turn == 0) == (F.col("kind") == 7), 1).otherwise(2)
    name = F.col("event_name")
    switch = name == "CTX_SWITCH"
    e = e.withColumns(
        {
            "own_task": F.when(name.isin("TASK_READY", "TASK_BLOCK", "TASK_WAKEUP", "TASK_DISPATCH", "SYNC_LOCK", "SYNC_UNLOCK", "SYNC_TRY", "TASK_EXIT"), F.col("t")),
            "next_task_id": F.when(switch, F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(F.col("t"))),
            "own_obj": F.when((name == "TASK_WAKEUP") & (F.col("k") % 9 != 0) | name.isin("SYNC_LOCK", "SYNC_UNLOCK", "SYNC_TRY"), F.col("k") % 4),
            "wait_obj_id": F.when((name == "TASK_BLOCK") & (F.col("k") % 11 != 0), F.col("k") % 4),
            "owner_task_id": F.when(name == "TASK_BLOCK", (F.col("t") + 2) % 6 + 1),
            "irq_id": F.when(irq, depth.cast("long") if nested else F.col("j") % 3 + 1),
            "nesting_depth": F.when(irq, depth),
            "reason": F.when(name.isin("TASK_BLOCK", "CTX_SWITCH", "OVERFLOW"), F.col("k") % 4),
            "prio": F.when(name == "TASK_READY", F.col("t") % 5),
            "deadline_ts": F.when(name == "TASK_READY", F.col("ts_raw") + F.round(F.col("value") * 100).cast("long") * 1_000_000),
            "job_id": F.when(name.isin("TASK_READY", "TASK_EXIT") & (F.col("t") % 2 == 0), F.expr("ts_raw div 86400000000")),
            "lost_count": F.when(name == "LOSS", F.col("k") % 7 + 1),
            "overflow_count": F.when(name == "OVERFLOW", F.col("k") % 5 + 1),
        }
    )
    e = scan(e.withColumn("switch", switch), ["dataset_id", "core_id", "switch"], ["seq"], lag={"before": F.col("next_task_id")}, long=long)
    e = e.withColumn("prev_task_id", F.when(switch, F.coalesce("before", F.lit(0).cast("long"))))
    return e.where(F.col("event_id") % DROPPED != 0).select(
        "dataset_id",
        F.concat_ws(":", F.lit("evt"), "dataset_id", "core_id", "seq").alias("event_uid"),
        "core_id",
        "seq",
        "ts_raw",
        "event_name",
        F.coalesce("own_task", "next_task_id").alias("task_id"),
        F.coalesce("own_obj", "wait_obj_id").alias("obj_id"),
        *"prev_task_id next_task_id wait_obj_id owner_task_id irq_id nesting_depth reason prio deadline_ts job_id lost_count overflow_count".split(),
    )


def sql(dataset_events: int = DATASET_EVENTS, nested: bool = False) -> dict[str, str]:
    """The view in DuckDB SQL."""
    turn = "(j // 4) % 4"
    depth = f"CASE WHEN {turn} IN (1, 2) THEN 3 WHEN ({turn} = 0) = (kind = 7) THEN 1 ELSE 2 END" if nested else "1"
    return {
        "named": f"""SELECT *, row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY ts_raw, event_id) AS seq,
  CASE kind WHEN 0 THEN 'TASK_READY' WHEN 1 THEN 'TASK_BLOCK' WHEN 2 THEN 'TASK_WAKEUP' WHEN 3 THEN 'TASK_DISPATCH' WHEN 4 THEN 'CTX_SWITCH'
    WHEN 5 THEN 'SYNC_LOCK' WHEN 6 THEN 'SYNC_UNLOCK' WHEN 7 THEN {f"CASE {turn} WHEN 3 THEN 'IRQ_EXIT' ELSE 'IRQ_ENTER' END" if nested else "'IRQ_ENTER'"} WHEN 8 THEN {f"CASE {turn} WHEN 0 THEN 'IRQ_ENTER' ELSE 'IRQ_EXIT' END" if nested else "'IRQ_EXIT'"} WHEN 9 THEN 'CTX_SWITCH' WHEN 10 THEN 'TASK_EXIT'
    ELSE CASE (j // 4) % 4 WHEN 0 THEN CASE WHEN core_id = 0 THEN 'SYNC_CALIB' ELSE 'TS_CALIB' END WHEN 1 THEN 'LOSS' WHEN 2 THEN 'OVERFLOW' ELSE 'SYNC_TRY' END END AS event_name
  FROM (SELECT CAST(event_id // {dataset_events} AS varchar) AS dataset_id, event_id, epoch_us(ts) AS ts_raw, CAST((event_id // 12) % 4 AS int) AS core_id, event_id % 12 AS kind,
          event_id // 12 AS j, user_id % 6 + 1 AS t, CAST(json_extract_string(props, '$.k') AS bigint) AS k, value FROM events) AS x""",
        "payload": f"""SELECT *, CASE WHEN event_name IN ('TASK_READY', 'TASK_BLOCK', 'TASK_WAKEUP', 'TASK_DISPATCH', 'SYNC_LOCK', 'SYNC_UNLOCK', 'SYNC_TRY', 'TASK_EXIT') THEN t END AS own_task,
  CASE WHEN event_name = 'CTX_SWITCH' THEN CASE WHEN k % 5 = 0 THEN 0 ELSE t END END AS next_task_id,
  CASE WHEN event_name = 'TASK_WAKEUP' AND k % 9 <> 0 OR event_name IN ('SYNC_LOCK', 'SYNC_UNLOCK', 'SYNC_TRY') THEN k % 4 END AS own_obj,
  CASE WHEN event_name = 'TASK_BLOCK' AND k % 11 <> 0 THEN k % 4 END AS wait_obj_id, CASE WHEN event_name = 'TASK_BLOCK' THEN (t + 2) % 6 + 1 END AS owner_task_id,
  CASE WHEN event_name LIKE 'IRQ%' THEN {depth if nested else 'j % 3 + 1'} END AS irq_id, CASE WHEN event_name LIKE 'IRQ%' THEN {depth} END AS nesting_depth,
  CASE WHEN event_name IN ('TASK_BLOCK', 'CTX_SWITCH', 'OVERFLOW') THEN k % 4 END AS reason, CASE WHEN event_name = 'TASK_READY' THEN t % 5 END AS prio,
  CASE WHEN event_name = 'TASK_READY' THEN ts_raw + CAST(round(value * 100) AS bigint) * 1000000 END AS deadline_ts,
  CASE WHEN event_name IN ('TASK_READY', 'TASK_EXIT') AND t % 2 = 0 THEN ts_raw // 86400000000 END AS job_id,
  CASE WHEN event_name = 'LOSS' THEN k % 7 + 1 END AS lost_count, CASE WHEN event_name = 'OVERFLOW' THEN k % 5 + 1 END AS overflow_count FROM named""",
        "ev": """SELECT dataset_id, 'evt:' || dataset_id || ':' || core_id || ':' || seq AS event_uid, core_id, seq, ts_raw, event_name, coalesce(own_task, next_task_id) AS task_id,
  coalesce(own_obj, wait_obj_id) AS obj_id, prev_task_id, next_task_id, wait_obj_id, owner_task_id, irq_id, nesting_depth, reason, prio, deadline_ts, job_id, lost_count, overflow_count
  FROM (SELECT *, CASE WHEN event_name = 'CTX_SWITCH' THEN coalesce(lag(next_task_id) OVER (PARTITION BY dataset_id, core_id, event_name = 'CTX_SWITCH' ORDER BY seq), 0) END AS prev_task_id FROM payload) AS x
  WHERE event_id % 97 <> 0""",
    }


SQL = sql()
