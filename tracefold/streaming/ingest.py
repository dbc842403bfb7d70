"""Continuous ingest: events arriving as files, with gaps, states and slices followed per key.

The log of all events is the truth. Streams put each key's rows in order
behind a watermark, so batches may come shuffled within it, and give the
intervals that a batch run over the log gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def stream_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(events: DataFrame, log: str, checkpoint: str) -> None:
    """Append all that is there to the log, each batch once, and stop."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={epoch}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What moves the watermark on when traces are silent: an event of this name, in any dataset.
HEARTBEAT = "HEARTBEAT"


class Ordered(StatefulProcessor):
    """Rows of a key in the order of their time, whatever batch they come in.

    Rows wait in a map of time buckets until the watermark has passed them; then
    ``step`` gets them one by one, in order of their values. A timer at the next
    waiting row, or ``idle`` ms behind the last one, wakes a key that gets no
    more rows; an idle key gives its open end (``rest``) and is forgotten.
    Rows behind the watermark are dropped by Spark; the log keeps them.
    """

    #: Columns of the input that make a row; the first is its time in microseconds.
    values: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __init__(self, width: int, idle: int):
        self.width, self.idle = width, idle

    def step(self, key: tuple, now: list | None, row: list, out: list) -> list | None:
        """The new state of a key; closed intervals go to ``out``."""
        raise NotImplementedError

    def rest(self, key: tuple, now: list | None, out: list) -> None:
        """What is open when a key is idle."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows string")
        self.now = handle.getValueState("now", "last long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        for frame in rows:
            for row in zip(*(frame[c].tolist() for c in self.values), strict=True):
                fresh.setdefault(int(row[0]) // self.width, []).append(row)
        for bucket, new in fresh.items():
            held = json.loads(self.waiting.getValue((bucket,))[0]) if self.waiting.containsKey((bucket,)) else []
            self.waiting.updateValue((bucket,), (json.dumps(held + new),))
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key: tuple, watermark: int) -> pd.DataFrame:
        passed, ready, later, out = watermark * 1000, [], None, []
        for bucket in sorted(k[0] for k in self.waiting.keys()):
            if bucket * self.width > passed:
                later = bucket * self.width if later is None else later
                break
            held = json.loads(self.waiting.getValue((bucket,))[0])
            ready += [r for r in held if r[0] <= passed]
            held = [r for r in held if r[0] > passed]
            if held:
                self.waiting.updateValue((bucket,), (json.dumps(held),))
                later = min(r[0] for r in held) if later is None else later
            else:
                self.waiting.removeKey((bucket,))
        last, state = (self.now.get()[0], json.loads(self.now.get()[1])) if self.now.exists() else (None, None)
        for row in sorted(ready):
            last, state = row[0], self.step(key, state, row, out)
        if later is not None:
            self.handle.registerTimer(max(later // 1000, watermark) + 1)
        elif last is not None and watermark > last // 1000 + self.idle:
            self.rest(key, state, out)
            last = state = None
            self.now.clear()
        elif last is not None:
            self.handle.registerTimer(last // 1000 + self.idle + 1)
        if last is not None:
            self.now.update((last, json.dumps(state)))
        return pd.DataFrame(out, columns=list(self.columns), dtype=object)

    def close(self) -> None:
        pass


class GapFinder(Ordered):
    """Per core: the last seq and time; gives a window where the sequence breaks."""

    values = ("ts_raw", "seq")
    columns = ("dataset_id", "core_id", "seq", "t_begin", "t_end")

    def step(self, key, now, row, out):
        ts, seq = row
        if now is not None and seq != now[0] + 1:
            out.append((*key, seq, min(now[1], ts), max(now[1], ts)))
        return [seq, ts]


class SliceFollower(Ordered):
    """Per core: the slice that is open; a switch closes it and may open the next."""

    values = ("ts_raw", "seq", "next_task_id", "event_uid")
    columns = ("dataset_id", "core_id", "task_id", "t_begin", "t_end", "start_event", "end_event")

    def step(self, key, now, row, out):
        ts, _, task, uid = row
        if now is not None and now[0]:
            out.append((*key, now[0], now[1], ts, now[2], uid))
        return [task, ts, uid]

    def rest(self, key, now, out):
        if now is not None and now[0]:
            out.append((*key, now[0], now[1], None, now[2], None))


class StateFollower(Ordered):
    """Per task: the state that is open; a switch-out makes it READY only if it is RUNNING."""

    values = ("ts_raw", "core_id", "seq", "sub", "state", "cond")
    columns = ("dataset_id", "task_id", "state", "t_begin", "t_end")

    def step(self, key, now, row, out):
        ts, _, _, _, state, cond = row
        if cond and (now is None or now[0] != "RUNNING"):
            return now
        if now is not None:
            out.append((*key, now[0], now[1], ts))
        return [state, ts]

    def rest(self, key, now, out):
        if now is not None:
            out.append((*key, now[0], now[1], None))


def _followed(rows: DataFrame, keys: list[str], follower: type[Ordered], schema: str, late: int, idle: int) -> DataFrame:
    """Rows (with event_name) in the care of a follower. Heartbeats stay in up to here, as a filter would move below the watermark that they are for; no follower sees them."""
    timed = rows.withColumn("at", F.timestamp_micros("ts_raw")).withWatermark("at", f"{late} milliseconds")
    # a key of its own, whose rows change nothing
    beat = F.col("event_name") == HEARTBEAT
    kept = timed.withColumns({k: F.when(beat, F.lit(None)).otherwise(F.col(k)) for k in keys})
    out = kept.groupBy(*keys).transformWithStateInPandas(follower(max(1, late * 1000 // 8), idle), schema, "Append", "EventTime")
    return out.where(F.col(keys[0]).isNotNull())


def stream_seq_gaps(events: DataFrame, late: int = 600_000, idle: int = 3_600_000) -> DataFrame:
    """Windows where a core's sequence breaks; rows up to ``late`` ms behind the newest come in any order."""
    rows = events.select("dataset_id", "core_id", "event_name", "ts_raw", "seq")
    return _followed(rows, ["dataset_id", "core_id"], GapFinder, "dataset_id string, core_id int, seq long, t_begin long, t_end long", late, idle)


def stream_slices(events: DataFrame, late: int = 600_000, idle: int = 3_600_000) -> DataFrame:
    """Execution slices of each core; the one that is open when a core falls idle has no end."""
    switches = events.where(F.col("event_name").isin("CTX_SWITCH", HEARTBEAT)).select("dataset_id", "core_id", "event_name", "ts_raw", "seq", F.coalesce("next_task_id", F.lit(0).cast("long")).alias("next_task_id"), "event_uid")
    schema = "dataset_id string, core_id int, task_id long, t_begin long, t_end long, start_event string, end_event string"
    return _followed(switches, ["dataset_id", "core_id"], SliceFollower, schema, late, idle)


def stream_state_segments(events: DataFrame, late: int = 600_000, idle: int = 3_600_000) -> DataFrame:
    """Task-state segments; the one that is open when a task falls idle has no end."""
    row = "array(named_struct('task_id', {}, 'state', '{}', 'cond', false, 'sub', 0))"
    changes = F.expr(
        "case when event_name = 'CTX_SWITCH' then filter(array(named_struct('task_id', prev_task_id, 'state', 'READY', 'cond', true, 'sub', 0), named_struct('task_id', next_task_id, 'state', 'RUNNING', 'cond', false, 'sub', 1)), x -> x.task_id <> 0)"
        f" when event_name in ('TASK_READY', 'TASK_WAKEUP') then {row.format('task_id', 'READY')} when event_name = 'TASK_BLOCK' then {row.format('task_id', 'BLOCKED')}"
        f" when event_name = 'TASK_EXIT' then {row.format('task_id', 'EXIT')} when event_name = '{HEARTBEAT}' then {row.format('0L', '')} end"
    )
    rows = events.select("dataset_id", "event_name", "ts_raw", "core_id", "seq", F.explode(changes).alias("c")).select("dataset_id", "event_name", "ts_raw", "core_id", "seq", "c.*")
    return _followed(rows, ["dataset_id", "task_id"], StateFollower, "dataset_id string, task_id long, state string, t_begin long, t_end long", late, idle)


def stream_bucket_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per core and tumbling window; rows later than the watermark are left to the log. To be run in update mode (``drain_updates``), which gives the windows that are still open too."""
    timed = events.withColumn("at", F.timestamp_micros("ts_raw")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "dataset_id", "core_id").agg(F.count("*").alias("events"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give its rows as a table."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Run a stream over what is there in update mode and give the last row of each key.

    A batch writes its updates under its number and overwrites them when it is
    run again, so a restart counts nothing twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
