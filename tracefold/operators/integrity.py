"""Untrusted windows and trust tags from sequence numbers, loss markers, chunks and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scans import scan

WINDOW_COLUMNS = ("dataset_id", "window_id", "source", "scope", "t_begin", "t_end", "reason_code", "severity")


def with_previous(events: DataFrame, long: bool | None = False) -> DataFrame:
    """Adds the core's previous seq and timestamp, and whether the sequence breaks here."""
    e = scan(events, ["dataset_id", "core_id"], ["seq"], lag={"prev_seq": F.col("seq"), "prev_ts": F.col("ts_raw")}, long=long)
    return e.withColumn("gap", F.coalesce(F.col("seq") != F.col("prev_seq") + 1, F.lit(False)))


def tag_events(events: DataFrame, long: bool | None = False) -> DataFrame:
    """Adds trust_tags and trusted; an event is trusted if it has no tag."""
    e = with_previous(events, long)
    marker = F.when(F.col("event_name") == "LOSS", "loss").when(F.col("event_name") == "OVERFLOW", F.when(F.col("reason") == 3, "io_backpressure").otherwise("overflow"))
    e = e.withColumn("trust_tags", F.array_compact(F.array(F.when(F.col("gap"), "seq_gap"), marker)))
    return e.withColumn("trusted", F.size("trust_tags") == 0).drop("prev_seq", "prev_ts", "gap")


def window_row(source, reason, begin, end, *key, scope="event", named=None, severity="warning"):
    ident = F.concat_ws(":", F.lit("uw"), "dataset_id", source if named is None else F.lit(named), *key)
    return [
        F.col("dataset_id"),
        ident.alias("window_id"),
        source.alias("source"),
        F.lit(scope).alias("scope"),
        F.least(begin, end).alias("t_begin"),
        F.greatest(begin, end).alias("t_end"),
        reason.alias("reason_code"),
        F.lit(severity).alias("severity"),
    ]


def seq_gap_windows(events: DataFrame, long: bool | None = False) -> DataFrame:
    e = with_previous(events, long).where("gap")
    return e.select(*window_row(F.lit("seq_gap"), F.lit("SEQ_GAP"), F.col("prev_ts"), F.col("ts_raw"), "core_id", "seq"))


def loss_overflow_windows(events: DataFrame, long: bool | None = False) -> DataFrame:
    e = with_previous(events, long).where(F.col("event_name").isin("LOSS", "OVERFLOW"))
    pressure = F.col("reason") == 3
    source = F.when(F.col("event_name") == "LOSS", "loss").when(pressure, "io_backpressure").otherwise("overflow")
    reason = F.when(F.col("event_name") == "LOSS", "SEQ_GAP").when(pressure, "IO_BACKPRESSURE").otherwise("BUFFER_OVERFLOW")
    return e.select(*window_row(source, reason, F.coalesce("prev_ts", "ts_raw"), F.col("ts_raw"), "core_id", "seq"))


def chunk_window(source: str, reason, named: str, severity: str = "warning"):
    return window_row(F.lit(source), reason, F.col("t_begin"), F.col("t_end"), "chunk_id", named=named, severity=severity)


def crc_windows(chunks: DataFrame) -> DataFrame:
    """chunks: dataset_id, chunk_id, payload, crc, t_begin, t_end. Chunks whose payload doesn't have the header's checksum."""
    return chunks.where(F.crc32("payload") != F.col("crc")).select(*chunk_window("crc_fail", F.lit("CRC_FAIL"), "crc"))


def dictionary_windows(chunks: DataFrame) -> DataFrame:
    """chunks: dataset_id, chunk_id, header_dict, segment_dict, chunk_dict, t_begin, t_end. Chunks, and segments (by their first chunk), of another dictionary than the trace's header."""
    own = chunks.where("chunk_dict <> header_dict").select(*chunk_window("dict_mismatch", F.lit("DICT_MISMATCH"), "dict"))
    segment = chunks.where("chunk_id = 0 and segment_dict <> header_dict").select(*chunk_window("dict_mismatch", F.lit("DICT_MISMATCH"), "segment-meta"))
    return own.unionByName(segment)


def truncation_windows(problems: DataFrame) -> DataFrame:
    """problems: dataset_id, chunk_id, problem, t_begin, t_end: cut events, payloads and chunks."""
    return problems.where(F.col("problem").startswith("TRUNCATED")).select(*chunk_window("truncate", F.col("problem"), "truncate", "error"))


def segment_chain_windows(segments: DataFrame) -> DataFrame:
    """segments: dataset_id, position, segment_seq, prev_segment_seq, dict_checksum, t_begin, t_end. Breaks of the numbering and changes of the dictionary's checksum (0: not known)."""
    w = W.partitionBy("dataset_id").orderBy("position")
    s = segments.withColumns({"last_seq": F.lag("segment_seq").over(w), "last_sum": F.lag("dict_checksum").over(w)})
    broken = (F.col("prev_segment_seq") != F.col("last_seq")) | (F.col("segment_seq") != F.col("last_seq") + 1)
    conflict = (F.col("dict_checksum") != 0) & (F.col("last_sum") != 0) & (F.col("dict_checksum") != F.col("last_sum"))
    rows = [(broken, "SEGMENT_CHAIN_BREAK", "segment-chain"), (conflict, "SEGMENT_DICT_CONFLICT", "segment-dict")]
    return reduce(DataFrame.unionByName, [s.where(c).select(*window_row(F.lit("segment_chain"), F.lit(r), F.col("t_begin"), F.col("t_end"), "segment_seq", named=n)) for c, r, n in rows])


SQL = {
    "prev": "SELECT *, lag(seq) OVER w AS prev_seq, lag(ts_raw) OVER w AS prev_ts FROM ev WINDOW w AS (PARTITION BY dataset_id, core_id ORDER BY seq)",
    "tagged": """SELECT *, list_filter([CASE WHEN prev_seq IS NOT NULL AND seq <> prev_seq + 1 THEN 'seq_gap' END,
  CASE WHEN event_name = 'LOSS' THEN 'loss' WHEN event_name = 'OVERFLOW' AND reason = 3 THEN 'io_backpressure' WHEN event_name = 'OVERFLOW' THEN 'overflow' END], lambda x: x IS NOT NULL) AS trust_tags,
  NOT ((prev_seq IS NOT NULL AND seq <> prev_seq + 1) OR event_name IN ('LOSS', 'OVERFLOW')) AS trusted FROM prev""",
    "gap_windows": """SELECT dataset_id, 'uw:' || dataset_id || ':seq_gap:' || core_id || ':' || seq AS window_id, 'seq_gap' AS source, 'event' AS scope,
  least(prev_ts, ts_raw) AS t_begin, greatest(prev_ts, ts_raw) AS t_end, 'SEQ_GAP' AS reason_code, 'warning' AS severity FROM prev WHERE seq <> prev_seq + 1""",
    "loss_windows": """SELECT dataset_id, 'uw:' || dataset_id || ':' || source || ':' || core_id || ':' || seq AS window_id, source, 'event' AS scope, least(coalesce(prev_ts, ts_raw), ts_raw) AS t_begin,
  greatest(coalesce(prev_ts, ts_raw), ts_raw) AS t_end, CASE source WHEN 'loss' THEN 'SEQ_GAP' WHEN 'io_backpressure' THEN 'IO_BACKPRESSURE' ELSE 'BUFFER_OVERFLOW' END AS reason_code, 'warning' AS severity
  FROM (SELECT *, CASE WHEN event_name = 'LOSS' THEN 'loss' WHEN reason = 3 THEN 'io_backpressure' ELSE 'overflow' END AS source FROM prev WHERE event_name IN ('LOSS', 'OVERFLOW')) AS x""",
}
