"""Registered queries: streams over the trace events, arriving as several files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import shared_dir
from ..sources.trace_view import trace_events
from ..streaming import feed
from ..streaming import ingest as st
from .chunk_queries import V as CHUNK_VIEWS, _HAS, segments
from .sql import VIEWS, with_views

FILES = 4
#: Files of a batch.
BATCH = 4


def _arrived(s, d, shuffled=True):
    """Trace events in a folder as files that arrive one after another, a scratch path, and in ms how late rows come and how long a key is silent at most.

    Files go by time plus a random shift of up to an eighth of the whole range,
    so neighbours in time come in different batches. The last file is a
    heartbeat far behind all events.
    """
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = trace_events(s, d)
    lo, hi = events.agg(F.min("ts_raw"), F.max("ts_raw")).first()
    shift = (hi - lo) // 8 if shuffled else 0
    late, idle = shift // 1000 + 1, (hi - lo) // 500 + 1000
    at = F.col("ts_raw") + F.pmod(F.xxhash64("event_uid"), F.lit(shift + 1))
    part = F.least(F.lit(FILES - 1), F.floor((at - lo) * FILES / max(1, hi - lo + shift)))
    for i in range(FILES):
        events.where(part == i).repartition(BATCH, "event_uid").write.mode("append").parquet(f"{base}/in/part={i}")
    beat = {"event_name": F.lit(st.HEARTBEAT), "ts_raw": F.lit(hi + 1000 * (2 * late + idle + 1000)).cast("long"), "dataset_id": F.lit("clock"), "core_id": F.lit(0), "seq": F.lit(0).cast("long")}
    one = s.range(1).select(*[(beat[f.name] if f.name in beat else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    one.write.mode("append").parquet(f"{base}/in/part={FILES}")
    return st.stream_events(s, f"{base}/in/*", events.schema, BATCH), base, late, idle


def _stream(f):
    def run(s, d):
        events, base, late, idle = _arrived(s, d)
        return st.drain(f(events, late, idle), f"{base}/out", f"{base}/checkpoint")

    return run


def _fed(s, d):
    """The segment files of all traces as bytes in pieces of 1000 that arrive in shuffled batches."""
    base = f"{shared_dir(s)}/feed-{uuid.uuid4().hex}"
    pieces = segments(s, d).select("path", "content", F.explode(F.expr("sequence(0, (octet_length(content) - 1) div 1000)")).alias("piece"))
    pieces = pieces.select("path", F.col("piece").cast("long").alias("piece"), F.expr("substring(content, piece * 1000 + 1, 1000)").alias("content"), F.expr("piece = (octet_length(content) - 1) div 1000").alias("last"))
    for i in range(FILES):
        pieces.where(F.pmod(F.xxhash64("path", "piece"), F.lit(FILES)) == i).repartition(BATCH, "path").write.mode("append").parquet(f"{base}/in/part={i}")
    rows = feed.stream_feed(st.stream_events(s, f"{base}/in/*", T._parse_datatype_string(feed.PIECES), BATCH))
    return st.drain(rows, f"{base}/out", f"{base}/checkpoint").select("path", "chunk_id", "core_id", "seq", "ts_raw", "event_name", "task_id", "crc_ok", "problem")


def _ingested(s, d):
    events, base, *_ = _arrived(s, d)
    st.ingest(events.where(F.col("event_name") != st.HEARTBEAT), f"{base}/log", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/log").groupBy("dataset_id", "core_id").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


def _counted(s, d):
    events, base, late, _ = _arrived(s, d)
    counts = st.stream_bucket_counts(events.where(F.col("event_name") != st.HEARTBEAT), late=f"{late} milliseconds").select(F.unix_micros("w.start").alias("w_begin"), "dataset_id", "core_id", "events")
    return st.drain_updates(counts, f"{base}/out", f"{base}/checkpoint", ["w_begin", "dataset_id", "core_id"])


QUERIES = {
    "w01_incremental_ingest": _ingested,
    "w05_stream_bucket_counts": _counted,
}
SQL = {
    "w01_incremental_ingest": "SELECT dataset_id, core_id, count(*) AS events, max(seq) AS last_seq FROM ev GROUP BY ALL",
    "w05_stream_bucket_counts": "SELECT ts_raw - ts_raw % 3600000000 AS w_begin, dataset_id, core_id, count(*) AS events FROM ev GROUP BY ALL",
}
ORACLE = {k: with_views(v) for k, v in SQL.items()}

#: Stateful streams, where the session has the state store that they need.
STATEFUL = {"w03_stream_seq_gaps": st.stream_seq_gaps, "w04_stream_slices": st.stream_slices, "w04_stream_state_segments": st.stream_state_segments}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(run_stream):
    def run(s, d):
        before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
        s.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        try:
            return run_stream(s, d)
        finally:
            s.conf.set("spark.sql.streaming.stateStore.providerClass", before)

    return run


QUERIES |= {k: _stateful(_stream(f)) for k, f in STATEFUL.items()} | {"w01_byte_feed": _stateful(_fed)}
SQL_STATEFUL = {
    "w03_stream_seq_gaps": "SELECT dataset_id, core_id, seq, least(prev_ts, ts_raw) AS t_begin, greatest(prev_ts, ts_raw) AS t_end FROM prev WHERE seq <> prev_seq + 1",
    "w04_stream_slices": "SELECT dataset_id, core_id, next_task_id AS task_id, ts_raw AS t_begin, c_ts AS t_end, event_uid AS start_event, c_uid AS end_event FROM (SELECT *, lead(ts_raw) OVER w AS c_ts, lead(event_uid) OVER w AS c_uid FROM ev WHERE event_name = 'CTX_SWITCH' WINDOW w AS (PARTITION BY dataset_id, core_id ORDER BY ts_raw, seq)) AS x WHERE next_task_id <> 0",
}
#: The rebuild's views over raw times, as events arrive unaligned.
RAW = {n: VIEWS[v].replace("FROM al", "FROM raw_al").replace("FROM changes", "FROM raw_changes") for n, v in (("raw_changes", "changes"), ("raw_accepted", "accepted"))}
RAW["raw_al"] = "SELECT *, ts_raw AS ts, true AS trusted FROM ev"
SQL_STATEFUL["w04_stream_state_segments"] = """SELECT dataset_id, task_id, state, ts AS t_begin, t_end FROM (SELECT *, lead(ts) OVER (PARTITION BY dataset_id, task_id ORDER BY ts, core_id, seq, sub) AS t_end FROM raw_accepted) AS x"""
ORACLE |= {k: with_views(v, RAW) for k, v in SQL_STATEFUL.items()}
ORACLE["w01_byte_feed"] = with_views(
    "SELECT dataset_id AS path, chunk_id, core_id, seq, ts_raw, event_name, CASE WHEN event_name IN (" + ", ".join(repr(n) for n in _HAS["task_id"]) + ") THEN coalesce(task_id, 0) END AS task_id, chunk_id <> 2 AS crc_ok, NULL AS problem FROM read_rows"
    " UNION ALL SELECT dataset_id, chunk_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN problem <> 'TRUNCATED_CHUNK' THEN true END, problem FROM cut",
    CHUNK_VIEWS,
)
