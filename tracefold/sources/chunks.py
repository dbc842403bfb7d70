"""Binary segment files of event chunks: catalogue, decoding of single chunks, previews and window reads.

A segment is a global header, from format 2 on a segment header, and chunks;
a chunk is a header and a payload of events, each a header and its fields.
Segments come as rows (path, content), from files (``files``) or any table,
and one pass over a segment gives its chunks, each with its own payload, so
that decoding is dealt out by chunk and no content is copied. Such a row has
2 GB at most; ``segments.py`` reads files of any size by seeking. What spans
chunks (sequence gaps, segment chains) is a window over rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlap_buckets, overlap_join

#: Fixed values of the format: marks, headers, and each event's number and fields.
TRACE_MARK, CHUNK_MARK, SEGMENT_MARK = 0x54524345, 0x43484B31, 0x53474D32
TRACE_HEADER = struct.Struct("<IHHHHHH16s32s32s")  # mark, endian, time unit, format, dictionary, header version, cores, clock, producer, run
SEGMENT_HEADER = struct.Struct("<IHHIIHHI")  # mark, header version, size, segment, segment before, dictionary, algorithm, dictionary checksum
CHUNK_HEADER = struct.Struct("<IHHIIQQQQII")  # mark, header version, core, events, bytes, first and last time, first and last seq, dictionary, crc
EVENT_HEADER = struct.Struct("<HHHHQQI")  # version, flags, core, event, seq, time, bytes
EVENTS = {
    "TASK_READY": (0x1001, "<IhHH", ("task_id", "prio", "core_hint", "reason")),
    "TASK_BLOCK": (0x1002, "<IQHI", ("task_id", "wait_obj_id", "reason", "owner_task_id")),
    "TASK_WAKEUP": (0x1003, "<IHQ", ("task_id", "wake_src", "obj_id")),
    "TASK_DISPATCH": (0x1004, "<IHhH", ("task_id", "core_hint", "prio", "reason")),
    "TASK_EXIT": (0x1005, "<Ii", ("task_id", "exit_code")),
    "CTX_SWITCH": (0x1006, "<HIIH", ("core_hint", "prev_task_id", "next_task_id", "reason")),
    "SCHED_DECISION": (0x1007, "<HIHH", ("core_hint", "task_id", "rq_len", "reason")),
    "SYNC_TRY": (0x2001, "<IQHQ", ("task_id", "obj_id", "obj_type", "timeout")),
    "SYNC_LOCK": (0x2002, "<IQHQ", ("task_id", "obj_id", "obj_type", "timeout")),
    "SYNC_UNLOCK": (0x2003, "<IQHQ", ("task_id", "obj_id", "obj_type", "timeout")),
    "IRQ_ENTER": (0x3001, "<HHB", ("irq_id", "core_hint", "nesting_depth")),
    "IRQ_EXIT": (0x3002, "<HHB", ("irq_id", "core_hint", "nesting_depth")),
    "LOSS": (0x4001, "<HIH", ("core_hint", "lost_count", "reason")),
    "OVERFLOW": (0x4002, "<HIH", ("core_hint", "overflow_count", "reason")),
    "SYNC_CALIB": (0x4003, "", ()),
    "TS_CALIB": (0x4004, "", ()),
}
BY_NUMBER = {number: (name, struct.Struct(layout), fields) for name, (number, layout, fields) in EVENTS.items()}
FIELDS = ("task_id", "prio", "reason", "wait_obj_id", "owner_task_id", "obj_id", "prev_task_id", "next_task_id", "irq_id", "nesting_depth", "lost_count", "overflow_count", "exit_code")

CATALOG = (
    "path string, format int, segment_seq long, prev_segment_seq long, dict_checksum long, header_dict int, segment_dict int, chunk_id int, header_offset long, payload_offset long, payload_size long,"
    " records int, crc long, core_id int, t_begin long, t_end long, seq_begin long, seq_end long, chunk_dict int, problem string, payload binary"
)
ROWS = "path string, chunk_id int, core_id int, seq long, ts_raw long, event_name string, " + ", ".join(f"{f} long" for f in FIELDS) + ", crc_ok boolean, problem string"


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")])


def encode_event(core: int, name: str, seq: int, ts: int, values: dict) -> bytes:
    number, layout, fields = EVENTS[name]
    payload = struct.pack(layout, *(int(values.get(f) or 0) for f in fields)) if layout else b""
    return EVENT_HEADER.pack(1, 0, core, number, seq, ts, len(payload)) + payload


def encode_chunk(core: int, rows: list[dict], dictionary: int = 1) -> bytes:
    """One chunk of event rows (event_name, seq, ts_raw and fields)."""
    payload = b"".join(encode_event(core, r["event_name"], r["seq"], r["ts_raw"], r) for r in rows)
    times, seqs = [r["ts_raw"] for r in rows] or [0], [r["seq"] for r in rows] or [0]
    return CHUNK_HEADER.pack(CHUNK_MARK, 1, core, len(rows), len(payload), min(times), max(times), min(seqs), max(seqs), dictionary, zlib.crc32(payload)) + payload


def encode_segment(run: str, chunks: list[bytes], cores: int = 1, dictionary: int = 1, segment: int = 1, before: int = 0, segment_dictionary: int | None = None, checksum: int = 0) -> bytes:
    head = TRACE_HEADER.pack(TRACE_MARK, 1, 1, 2, dictionary, 2, cores, b"steady_clock", b"tracefold", run.encode()[:32])
    meta = SEGMENT_HEADER.pack(SEGMENT_MARK, 2, SEGMENT_HEADER.size, segment, before, dictionary if segment_dictionary is None else segment_dictionary, 0, checksum)
    return head + meta + b"".join(chunks)


def read_head(data: bytes) -> tuple[dict, int, str | None]:
    """What the headers at the beginning of a segment tell, their size, and what is wrong with them (the size is then that of the good ones)."""
    at = TRACE_HEADER.size
    if len(data) < at:
        return {}, 0, "TRUNCATED_HEADER"
    mark, _, _, version, dictionary, *_ = TRACE_HEADER.unpack_from(data)
    if mark != TRACE_MARK:
        return {}, 0, "BAD_MARK"
    row = {"format": version, "header_dict": dictionary, "segment_seq": None, "prev_segment_seq": None, "dict_checksum": None, "segment_dict": None}
    if version < 2:
        return row, at, None
    if len(data) < at + SEGMENT_HEADER.size:
        return row, at, "TRUNCATED_HEADER"
    mark, _, size, segment, before, own, _, checksum = SEGMENT_HEADER.unpack_from(data, at)
    if mark != SEGMENT_MARK or size != SEGMENT_HEADER.size:
        return row, at, "BAD_MARK"
    return row | {"segment_seq": segment, "prev_segment_seq": before, "dict_checksum": checksum, "segment_dict": own}, at + size, None


HEAD_SIZE = TRACE_HEADER.size + SEGMENT_HEADER.size


def read_chunk_head(data: bytes) -> dict:
    _, _, core, records, size, t0, t1, s0, s1, own, crc = CHUNK_HEADER.unpack_from(data)
    return {"payload_size": size, "records": records, "crc": crc, "core_id": core, "t_begin": t0, "t_end": t1, "seq_begin": s0, "seq_end": s1, "chunk_dict": own}


def mark_of(data: bytes) -> int | None:
    return int.from_bytes(data[:4], "little") if len(data) >= 4 else None


def walk_chunks(path: str, size: int, read: Callable[[int, int], bytes], begin: int | None = None, end: int | None = None, first: int = 0) -> Iterator[dict]:
    """Rows of CATALOG without payloads, from the headers that ``read(offset, n)`` gives, of chunks that begin in begin..end.

    A file may hold several segments, each with its headers, one after another. Damage ends the walk with a row that names it.
    """
    row, at, problem = {"path": path, "chunk_id": first}, begin or 0, None
    if begin is None:
        told, at, problem = read_head(read(0, HEAD_SIZE))
        row |= told
    while problem is None and at < (size if end is None else min(end, size)):
        data = read(at, CHUNK_HEADER.size)
        mark = mark_of(data)
        if mark == TRACE_MARK:
            told, used, problem = read_head(read(at, HEAD_SIZE))
            row |= told
            at += used
        elif len(data) < CHUNK_HEADER.size:
            problem = "TRUNCATED_CHUNK"
        elif mark != CHUNK_MARK:
            problem = "BAD_MARK"
        else:
            told, start = read_chunk_head(data), at + CHUNK_HEADER.size
            whole = start + told["payload_size"] <= size
            yield row | told | {"header_offset": at, "payload_offset": start, "problem": None if whole else "TRUNCATED_CHUNK"}
            at = start + told["payload_size"]
            row["chunk_id"] += 1
    if problem is not None:
        yield row | {"header_offset": at, "payload_offset": at, "payload_size": size - at, "problem": problem}


def _chunks(path: str, content: bytes, payloads: bool) -> Iterator[dict]:
    """Rows of CATALOG of a whole content."""
    view = memoryview(content)
    for row in walk_chunks(path, len(content), lambda at, n: bytes(view[at : at + n])):
        start = row["payload_offset"]
        yield row | {"payload": bytes(view[start : start + row["payload_size"]]) if payloads and row["problem"] is None else None}


def _walk(payloads: bool):
    schema = arrow(CATALOG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_pylist(list(_chunks(path.as_py(), content.as_py(), payloads)), schema=schema)

    return run


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, a folder or a glob."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def chunk_catalog(segments: DataFrame, payloads: bool = False) -> DataFrame:
    """All chunks of the segments (path, content), from their headers, with damaged ones named; with their payloads if asked."""
    return segments.select("path", "content").mapInArrow(_walk(payloads), CATALOG)


def _events(payload: bytes, records: int) -> Iterator[dict]:
    at = 0
    for _ in range(records):
        if at + EVENT_HEADER.size > len(payload):
            yield {"problem": "TRUNCATED_EVENT"}
            return
        _, _, core, number, seq, ts, size = EVENT_HEADER.unpack_from(payload, at)
        at += EVENT_HEADER.size
        if at + size > len(payload):
            yield {"problem": "TRUNCATED_PAYLOAD"}
            return
        name, layout, fields = BY_NUMBER.get(number, (f"EVENT_{number:#x}", struct.Struct(""), ()))
        values = dict(zip(fields, layout.unpack_from(payload, at), strict=True)) if size >= layout.size else {}
        yield {"core_id": core, "seq": seq, "ts_raw": ts, "event_name": name} | values
        at += size


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow(ROWS)
    for batch in batches:
        for path, chunk, records, crc, payload in zip(*batch.columns, strict=True):
            data = payload.as_py()
            own = {"path": path.as_py(), "chunk_id": chunk.as_py(), "crc_ok": zlib.crc32(data) == crc.as_py()}
            yield pa.RecordBatch.from_pylist([own | e for e in _events(data, records.as_py())], schema=schema)


def decode(chunks: DataFrame) -> DataFrame:
    """The events of chunks with payloads, a row each; an event that the payload cuts off gives a row that names the problem."""
    return chunks.where("payload is not null").select("path", "chunk_id", "records", "crc", "payload").mapInArrow(_decode, ROWS)


def scan_trace(segments: DataFrame) -> DataFrame:
    """The events of segments (path, content), dealt out by chunk."""
    return decode(chunk_catalog(segments, payloads=True).repartition("path", "chunk_id"))


def prescan(catalog: DataFrame, n: int = 24) -> tuple[DataFrame, DataFrame]:
    """What the headers tell: (chunks, records, cores and time range of each path; events and chunks per time bucket of each path)."""
    good = catalog.where("core_id is not null").withColumnRenamed("path", "dataset_id")
    spans = good.groupBy("dataset_id").agg(F.count("*").alias("chunks"), F.sum("records").alias("records"), F.count_distinct("core_id").alias("cores"), F.min("t_begin").alias("w_begin"), F.max("t_end").alias("w_end"))
    parts = overlap_buckets(good.select("dataset_id", "t_begin", "t_end", "records"), spans.select("dataset_id", "w_begin", "w_end"), n)
    buckets = parts.groupBy("dataset_id", "bucket").agg(F.round(F.sum(F.col("part") * F.col("records")), 6).alias("events"), F.round(F.sum("part"), 6).alias("chunks"))
    return spans, buckets


def touched_chunks(catalog: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks whose core, time range and (where given) seq range a span (path, core_id, t_begin, t_end, seq_begin, seq_end) meets."""
    lean = catalog.where("core_id is not null").select("path", "chunk_id", "core_id", "t_begin", "t_end", F.col("seq_begin").alias("s0"), F.col("seq_end").alias("s1"), "payload_size")
    met = overlap_join(lean, spans, ["path", "core_id"], closed=True)
    return met.where("(seq_begin is null or s1 >= seq_begin) and (seq_end is null or s0 <= seq_end)").select("path", "chunk_id", "payload_size").distinct()


def inside_spans(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events with each span of their path and core that holds their time and seq (closed ends); the span's other columns come along."""
    points = events.withColumns({"t_begin": F.col("ts_raw"), "t_end": F.col("ts_raw")})
    inside = overlap_join(points, spans.withColumnsRenamed({"seq_begin": "s0", "seq_end": "s1"}), ["path", "core_id"], closed=True)
    return inside.where("(s0 is null or seq >= s0) and (s1 is null or seq <= s1)")
