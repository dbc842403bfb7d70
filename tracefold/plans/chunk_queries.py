"""Registered queries: binary segments made from the events table, read back whole, by span, and with damage."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions.tables import settle, shared_dir
from ..operators import integrity
from ..sources import chunks as ch
from ..sources import segments as seg
from ..sources.trace_view import trace_events
from .index_queries import V as INDEX_VIEWS, parts
from .sql import with_views

CHUNK = 64  # events of a chunk
SEGMENT = "path string, segment int, content binary"
KEPT = "dataset_id string, core_id int, event_name string, seq long, ts_raw long, " + ", ".join(f"{f} long" for f in ch.FIELDS if f != "exit_code")


def _segment(group: pd.DataFrame) -> pd.DataFrame:
    """One trace's binary segment, with damage in some chunks: number 2 has a wrong checksum, 3 another dictionary, 5 cut events."""
    dataset = group["dataset_id"].iloc[0]
    made: list[bytes] = []
    ordered = group.sort_values(["core_id", "seq"])
    for core, own in ordered.groupby("core_id"):
        rows = own.astype(object).where(own.notna(), None).to_dict("records")
        for at in range(0, len(rows), CHUNK):
            data = bytearray(ch.encode_chunk(int(core), rows[at : at + CHUNK], dictionary=2 if len(made) == 3 else 1))
            if len(made) == 2:
                data[ch.CHUNK_HEADER.size + 2] ^= 1  # the flags of its first event
            if len(made) == 5:
                head = list(ch.CHUNK_HEADER.unpack_from(data))
                data = data[:-4]
                head[4], head[10] = head[4] - 4, ch.zlib.crc32(data[ch.CHUNK_HEADER.size :])
                data[: ch.CHUNK_HEADER.size] = ch.CHUNK_HEADER.pack(*head)
            made.append(bytes(data))
    n = int(dataset)
    content = ch.encode_segment(dataset, made, 4, dictionary=1, segment=n + 1 + (n % 3 == 2), before=n, checksum=7 if n % 4 < 3 else 9)
    return pd.DataFrame({"path": [dataset], "segment": [n], "content": [content + b"cut" * (n % 2)]})


def segments(s, d):
    """(path, content): a segment for every trace of the events table, written once."""
    events = trace_events(s, d).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in KEPT.split(", ")])
    return settle(events.groupBy("dataset_id").applyInPandas(_segment, SEGMENT)).select("path", "content")


def files(s, d):
    """The folder that a segment file of every trace was written to."""
    path = f"{shared_dir(s)}/tracefold-{s.sparkContext.applicationId}/{uuid.uuid4().hex}"
    seg.write_segments(segments(s, d), path)
    return path


def _named(df):
    """Paths as the names of their traces."""
    return df.withColumn("path", F.regexp_extract("path", r"([^/]+)\.seg$", 1))


def _file_catalog(s, d):
    return _named(seg.catalog(s, files(s, d)))


def _read_spans(s, d):
    catalog = seg.catalog(s, files(s, d))
    paths = _named(catalog.select("path").distinct().select("path", F.col("path").alias("file")))
    spans = _spans(s, d).withColumn("refs", F.expr("if(core_id = 3, transform(sequence(0, 200), i -> concat('3:', i)), null)"))
    return seg.read_spans(catalog, spans.join(paths, "path").drop("path").withColumnRenamed("file", "path"))


def _catalog(s, d):
    return ch.chunk_catalog(segments(s, d)).drop("payload")


def _spans(s, d):
    """Of every trace and core, the middle tenth of its time, and seqs from 1 on for even cores."""
    t = trace_events(s, d).groupBy(F.col("dataset_id").alias("path"), "core_id").agg(F.min("ts_raw").alias("lo"), F.max("ts_raw").alias("hi"))
    return t.select("path", "core_id", F.expr("lo + (hi - lo) div 20 * 9").alias("t_begin"), F.expr("lo + (hi - lo) div 20 * 11").alias("t_end"), F.expr("if(core_id % 2 = 0, 1L, null)").alias("seq_begin"), F.lit(None).cast("long").alias("seq_end"))


def _segment_rows(s, d):
    """One row a segment, in the order of the traces."""
    return _catalog(s, d).where("chunk_id = 0").select(F.lit("all").alias("dataset_id"), F.col("path").cast("long").alias("position"), "segment_seq", "prev_segment_seq", F.col("dict_checksum"), "t_begin", "t_end")


def _payloads(s, d):
    return ch.chunk_catalog(segments(s, d), payloads=True).where("payload is not null").withColumn("dataset_id", F.col("path"))


QUERIES = {
    "s01_scan_trace": lambda s, d: _named(seg.read_events(s, files(s, d))).where("problem is null").select("path", "core_id", "seq", "ts_raw", "event_name", *[f for f in ch.FIELDS if f != "exit_code"], "crc_ok"),
    "s01_scan_range": lambda s, d: _named(seg.read_events(s, files(s, d), split=4096).where("core_id = 2 and seq >= 50 and seq < 300")).select("path", "core_id", "seq", "ts_raw", "event_name"),
    "s02_chunk_catalog": lambda s, d: _file_catalog(s, d).where("problem is null").select("path", "chunk_id", "core_id", "records", "t_begin", "t_end", "seq_begin", "seq_end", "segment_seq", "chunk_dict"),
    "s03_prescan_preview": lambda s, d: ch.prescan(_file_catalog(s, d).where("problem is null"))[0],
    "s03_prescan_buckets": lambda s, d: ch.prescan(_file_catalog(s, d).where("problem is null"))[1],
    "s12_read_window_spans": lambda s, d: _named(_read_spans(s, d)[0]),
    "s12_read_counters": lambda s, d: _named(_read_spans(s, d)[1]),
    "j05_chunk_span_overlap": lambda s, d: ch.touched_chunks(_file_catalog(s, d), _spans(s, d)).select("path", "chunk_id"),
    "i03_crc_windows": lambda s, d: integrity.crc_windows(_payloads(s, d)),
    "i04_truncation_windows": lambda s, d: integrity.truncation_windows(
        ch.decode(_payloads(s, d)).where("problem is not null").select("path", "chunk_id", "problem").join(_catalog(s, d).select("path", "chunk_id", "t_begin", "t_end"), ["path", "chunk_id"])
        .unionByName(_catalog(s, d).where("problem is not null").select("path", "chunk_id", "problem", "t_begin", "t_end")).withColumn("dataset_id", F.col("path"))
    ),
    "i05_dict_windows": lambda s, d: integrity.dictionary_windows(_catalog(s, d).where("core_id is not null").withColumn("dataset_id", F.col("path"))),
    "i06_segment_chain_windows": lambda s, d: integrity.segment_chain_windows(_segment_rows(s, d)),
}

_HAS = {f: [n for n, (_, _, fields) in ch.EVENTS.items() if f in fields] for f in ch.FIELDS}
V = {
    **INDEX_VIEWS,
    "rown": "SELECT *, CAST((row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY seq) - 1) // 64 AS int) AS own_chunk FROM ev",
    "own": "SELECT dataset_id, core_id, own_chunk, count(*) AS records, min(ts_raw) AS t_begin, max(ts_raw) AS t_end, min(seq) AS seq_begin, max(seq) AS seq_end FROM rown GROUP BY ALL",
    "chunks": "SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY core_id, own_chunk) - 1 AS int) AS chunk_id FROM own",
    "placed": "SELECT r.*, c.chunk_id, c.seq_end AS last_seq FROM rown AS r JOIN chunks AS c ON c.dataset_id = r.dataset_id AND c.core_id = r.core_id AND c.own_chunk = r.own_chunk",
    "read_rows": "SELECT * FROM placed WHERE NOT (chunk_id = 5 AND seq = last_seq)",
    "cut": """SELECT r.dataset_id, r.chunk_id, t_begin, t_end, CASE WHEN event_name LIKE '%CALIB' THEN 'TRUNCATED_EVENT' ELSE 'TRUNCATED_PAYLOAD' END AS problem FROM placed AS r JOIN chunks AS c ON c.dataset_id = r.dataset_id AND c.chunk_id = r.chunk_id
  WHERE r.chunk_id = 5 AND seq = last_seq UNION ALL SELECT dataset_id, count(*), NULL, NULL, 'TRUNCATED_CHUNK' FROM chunks WHERE CAST(dataset_id AS bigint) % 2 = 1 GROUP BY dataset_id""",
    "spans": "SELECT dataset_id, core_id, min(ts_raw) + (max(ts_raw) - min(ts_raw)) // 20 * 9 AS s_begin, min(ts_raw) + (max(ts_raw) - min(ts_raw)) // 20 * 11 AS s_end FROM ev GROUP BY ALL",
    "met": "SELECT c.* FROM chunks AS c JOIN spans AS s ON s.dataset_id = c.dataset_id AND s.core_id = c.core_id WHERE c.t_begin <= s_end AND s_begin <= c.t_end AND (c.core_id % 2 = 1 OR seq_end >= 1)",
    "inside": "SELECT r.* FROM read_rows AS r JOIN spans AS s ON s.dataset_id = r.dataset_id AND s.core_id = r.core_id WHERE ts_raw BETWEEN s_begin AND s_end AND (r.core_id <> 3 OR seq <= 200)",
    "sized": "SELECT dataset_id, chunk_id, sum(" + str(ch.EVENT_HEADER.size) + " + CASE event_name " + " ".join(f"WHEN '{n}' THEN {ch.struct.calcsize(layout)}" for n, (_, layout, _) in ch.EVENTS.items()) + " END) - CASE WHEN chunk_id = 5 THEN 4 ELSE 0 END AS size FROM placed GROUP BY dataset_id, chunk_id",
    "whole_c": "SELECT dataset_id, min(t_begin) AS w_begin, max(t_end) AS w_end FROM chunks GROUP BY dataset_id",
    "segs": "SELECT CAST(dataset_id AS bigint) AS n, CAST(dataset_id AS bigint) + 1 + CASE WHEN CAST(dataset_id AS bigint) % 3 = 2 THEN 1 ELSE 0 END AS seg, CASE WHEN CAST(dataset_id AS bigint) % 4 < 3 THEN 7 ELSE 9 END AS sum, t_begin, t_end FROM chunks WHERE chunk_id = 0",
    "chain": "SELECT *, lag(seg) OVER (ORDER BY n) AS last_seg, lag(sum) OVER (ORDER BY n) AS last_sum FROM segs",
}


def windows(rows: str, source: str, reason: str, named: str, dataset: str = "dataset_id", ident: str = "chunk_id", severity: str = "warning") -> str:
    return f"""SELECT {dataset} AS dataset_id, 'uw:' || {dataset} || ':{named}:' || {ident} AS window_id, '{source}' AS source, 'event' AS scope, least(t_begin, t_end) AS t_begin, greatest(t_begin, t_end) AS t_end, {reason} AS reason_code, '{severity}' AS severity FROM {rows}"""


SQL = {
    "s01_scan_trace": "SELECT dataset_id AS path, core_id, seq, ts_raw, event_name, "
    + ", ".join(f"CASE WHEN event_name IN ({', '.join(repr(n) for n in _HAS[f])}) THEN coalesce({f}, 0) END AS {f}" for f in ch.FIELDS if f != "exit_code")
    + ", chunk_id <> 2 AS crc_ok FROM read_rows",
    "s01_scan_range": "SELECT dataset_id AS path, core_id, seq, ts_raw, event_name FROM read_rows WHERE core_id = 2 AND seq >= 50 AND seq < 300",
    "s02_chunk_catalog": "SELECT dataset_id AS path, chunk_id, core_id, CAST(records AS int) AS records, t_begin, t_end, seq_begin, seq_end, CAST(dataset_id AS bigint) + 1 + CASE WHEN CAST(dataset_id AS bigint) % 3 = 2 THEN 1 ELSE 0 END AS segment_seq, CASE WHEN chunk_id = 3 THEN 2 ELSE 1 END AS chunk_dict FROM chunks",
    "s03_prescan_preview": "SELECT dataset_id, count(*) AS chunks, CAST(sum(records) AS bigint) AS records, count(DISTINCT core_id) AS cores, min(t_begin) AS w_begin, max(t_end) AS w_end FROM chunks GROUP BY dataset_id",
    "s03_prescan_buckets": f"SELECT dataset_id, bucket, round(sum(part * records), 6) AS events, round(sum(part), 6) AS chunks FROM ({parts('chunks', 'whole_c', 24).replace('SELECT dataset_id, CAST(b AS int)', 'SELECT dataset_id, records, CAST(b AS int)', 1)}) AS p GROUP BY ALL",
    "s12_read_window_spans": "SELECT dataset_id AS path, core_id, seq, ts_raw, event_name, CASE WHEN event_name IN (" + ", ".join(repr(n) for n in _HAS["task_id"]) + ") THEN coalesce(task_id, 0) END AS task_id FROM inside",
    "s12_read_counters": f"""SELECT path, chunks, coalesce(seeks, 0) AS seeks, CAST(coalesce(bytes, 0) AS bigint) AS bytes, CAST(span_total AS bigint) AS span_total, coalesce(decoded, 0) AS decoded, coalesce(kept, 0) AS kept, target_refs, target_refs - coalesce(found, 0) AS missed_refs,
  CASE WHEN target_refs = 0 THEN 1.0 ELSE round(coalesce(found, 0) * 1.0 / target_refs, 6) END AS hit_rate FROM (SELECT dataset_id AS path, count(*) + any_value(CAST(dataset_id AS bigint) % 2) AS chunks FROM chunks GROUP BY dataset_id) AS a
  LEFT JOIN (SELECT m.dataset_id AS path, count(*) AS seeks, sum(size) + count(*) * {ch.CHUNK_HEADER.size} AS bytes FROM met AS m JOIN sized AS z ON z.dataset_id = m.dataset_id AND z.chunk_id = m.chunk_id GROUP BY m.dataset_id) AS b USING (path)
  LEFT JOIN (SELECT r.dataset_id AS path, count(*) AS decoded FROM read_rows AS r SEMI JOIN met AS m ON m.dataset_id = r.dataset_id AND m.chunk_id = r.chunk_id GROUP BY r.dataset_id) AS c USING (path)
  LEFT JOIN (SELECT dataset_id AS path, sum(s_end - s_begin) AS span_total, 201 * count(*) FILTER (WHERE core_id = 3) AS target_refs FROM spans GROUP BY dataset_id) AS f USING (path)
  LEFT JOIN (SELECT dataset_id AS path, count(*) AS kept, count(*) FILTER (WHERE core_id = 3) AS found FROM inside GROUP BY dataset_id) AS e USING (path)""",
    "j05_chunk_span_overlap": "SELECT dataset_id AS path, chunk_id FROM met",
    "i03_crc_windows": windows("chunks WHERE chunk_id = 2", "crc_fail", "'CRC_FAIL'", "crc"),
    "i04_truncation_windows": windows("cut", "truncate", "problem", "truncate", severity="error"),
    "i05_dict_windows": windows("chunks WHERE chunk_id = 3", "dict_mismatch", "'DICT_MISMATCH'", "dict"),
    "i06_segment_chain_windows": windows("chain WHERE n <> last_seg OR seg <> last_seg + 1", "segment_chain", "'SEGMENT_CHAIN_BREAK'", "segment-chain", "'all'", "seg")
    + " UNION ALL "
    + windows("chain WHERE sum <> last_sum", "segment_chain", "'SEGMENT_DICT_CONFLICT'", "segment-dict", "'all'", "seg"),
}
ORACLE = {k: with_views(v, V) for k, v in SQL.items()}
