"""Segment files as a Spark data source that seeks: chunk headers first, and of payloads only those that a query needs.

``spark.read.format("trace_segments")`` reads a file or folder in any store
that Arrow can open (local or mounted folders, HDFS, object stores). With the
option ``rows = chunks`` it gives the catalogue from headers alone; with
``rows = events`` the events. Small files are grouped; a file above
``splitBytes`` is split at chunk bounds found from its headers, so a file has
no size limit and a partition is a range of chunks. Comparisons of ``path``,
``core_id``, ``ts_raw`` and ``seq`` with constants skip chunks by their
headers; Spark still applies them to the rows. Writing puts each row
(path, content) into a file of that name, by a rename when the job commits, so
a task that ran twice leaves one file.

``read_spans`` joins the catalogue with wanted spans in Spark and then reads
the touched chunks by offset. For stores that only Spark can read,
``chunks.files`` and ``chunks.chunk_catalog`` take whole contents instead.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.tables import settle
from . import chunks as ch
from .chunks import CHUNK_HEADER

NAME = "trace_segments"
SUFFIX = ".seg"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT_BYTES = 64 << 20
#: Files of a partition of the catalogue, rows of a batch of events, and partitions from which on small ranges are grouped.
FILES, ROWS, PARTITIONS = 64, 4096, 200
CHUNKS = ch.CATALOG.rsplit(", ", 1)[0]  # no payload


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def found(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the segment files of a folder, in order."""
    system, inner = store(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = system.get_file_info(pafs.FileSelector(inner))
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in inside if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))


class Segment:
    """An open segment file that counts what is read of it."""

    def __init__(self, path: str, size: int | None = None):
        system, inner = store(path)
        self.path, self.file = path, system.open_input_file(inner)
        self.size = self.file.size() if size is None else size
        self.bytes_read = 0

    def at(self, offset: int, n: int) -> bytes:
        data = self.file.read_at(n, offset)
        self.bytes_read += len(data)
        return data

    def chunks(self, begin: int | None = None, end: int | None = None, first: int = 0) -> Iterator[dict]:
        """Rows of CHUNKS from the headers of chunks that begin in begin..end."""
        return ch.walk_chunks(self.path, self.size, lambda offset, n: self.at(offset, min(n, self.size - offset)), begin, end, first)

    def events(self, chunk: dict) -> Iterator[dict]:
        """Rows of chunks.ROWS of one whole chunk."""
        data = self.at(chunk["payload_offset"], chunk["payload_size"])
        own = {"path": self.path, "chunk_id": chunk["chunk_id"], "crc_ok": zlib.crc32(data) == chunk["crc"]}
        return (own | e for e in ch._events(data, chunk["records"]))

    def close(self) -> None:
        self.file.close()


@dataclass
class Bounds:
    """Least and greatest wanted values by column; a chunk whose header lies outside any is skipped."""

    low: dict[str, int]
    high: dict[str, int]
    paths: set[str] | None = None

    @classmethod
    def of(cls, filters: list[Filter]) -> Bounds:
        out = cls({}, {})
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "path" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                out.paths = values if out.paths is None else out.paths & values
            elif name in ("core_id", "ts_raw", "seq"):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    out.low[name] = max(out.low.get(name, f.value), f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    out.high[name] = min(out.high.get(name, f.value), f.value)
                if isinstance(f, In):
                    values = [v for v in f.value if v is not None] or [-1]
                    out.low[name], out.high[name] = max(out.low.get(name, min(values)), min(values)), min(out.high.get(name, max(values)), max(values))
        return out

    def meet(self, chunk: dict) -> bool:
        spans = {"core_id": ("core_id", "core_id"), "ts_raw": ("t_begin", "t_end"), "seq": ("seq_begin", "seq_end")}
        return all(chunk[spans[c][1]] >= v for c, v in self.low.items()) and all(chunk[spans[c][0]] <= v for c, v in self.high.items())


class Ranges(InputPartition):
    """Ranges of chunks: (path, size, first header, end, number of the first chunk); null bounds are the whole file."""

    def __init__(self, ranges: list[tuple]):
        super().__init__(ranges)


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, rows: str, split: int):
        self.path, self.rows, self.split = path, rows, split
        self.bounds = Bounds({}, {})

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.bounds = Bounds.of(filters)
        return filters  # headers only rule chunks out, so rows are still tested

    def ranges(self, file: tuple[str, int]) -> list[tuple]:
        """A big file's ranges of about ``split`` bytes, those without a wanted chunk left out."""
        path, size = file
        if self.rows == "chunks" or size <= self.split:
            return [(path, size, None, None, 0)]
        segment, out, wanted = Segment(path, size), [], False
        for c in segment.chunks():
            whole = c["problem"] is None
            if not out or c["header_offset"] - out[-1][2] >= self.split:
                if out and not wanted:
                    out.pop()
                if out and out[-1][3] is None:
                    out[-1] = (*out[-1][:3], c["header_offset"], out[-1][4])
                out.append((path, size, c["header_offset"], None, c["chunk_id"]))
                wanted = False
            wanted |= whole and self.bounds.meet(c)
        if out and not wanted:
            out.pop()
        segment.close()
        return out

    def partitions(self) -> list[InputPartition]:
        files = [f for f in found(self.path) if self.bounds.paths is None or f[0] in self.bounds.paths]
        with ThreadPoolExecutor(16) as pool:
            ranges = [r for own in pool.map(self.ranges, files) for r in own]
        out, held, size = [], [], 0
        length = lambda r: (r[3] or r[1]) - (r[2] or 0)
        # many small ranges share a partition, so that tasks don't grow with the files or with a small split
        most = max(self.split, min(SPLIT_BYTES, sum(map(length, ranges)) // PARTITIONS))
        together = max(FILES, len(ranges) // PARTITIONS)
        for r in ranges:
            here = length(r)
            if held and (len(held) >= together or self.rows == "events" and size + here > most):
                out.append(Ranges(held))
                held, size = [], 0
            held.append(r)
            size += here
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = ch.arrow(CHUNKS if self.rows == "chunks" else ch.ROWS)
        held: list[dict] = []
        for path, size, begin, end, first in partition.value:
            segment = Segment(path, size)
            for c in segment.chunks(begin, end, first):
                if self.rows == "chunks":
                    held.append(c)
                elif c["problem"] is None and self.bounds.meet(c):
                    held += segment.events(c)
                while len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held[:ROWS], schema=schema)
                    held = held[ROWS:]
            segment.close()
        yield pa.RecordBatch.from_pylist(held, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SegmentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.part = path.rstrip("/"), overwrite, f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, inner = store(self.path)
        system.create_dir(f"{inner}/{self.part}", recursive=True)
        out = []
        for row in iterator:
            temporary = f"{inner}/{self.part}/{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as stream:
                stream.write(row.content)
            out.append((temporary, f"{inner}/{row.path}{SUFFIX}"))
        return Written(out)

    def commit(self, messages: list) -> None:
        system, inner = store(self.path)
        if self.overwrite:
            for old, _ in found(self.path):
                system.delete_file(store(old)[1])
        for message in messages:
            for temporary, final in message.files if message else []:
                system.move(temporary, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, inner = store(self.path)
        if system.get_file_info(f"{inner}/{self.part}").type == pafs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.part}")


class SegmentSource(DataSource):
    """Options: path, rows (events or chunks), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CHUNKS if self.options.get("rows") == "chunks" else ch.ROWS

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], self.options.get("rows", "events"), int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
    spark.conf.set(PUSHDOWN, "true")


def write_segments(segments: DataFrame, path: str) -> None:
    """Writes rows (path, content) as files of a folder."""
    register(segments.sparkSession)
    segments.select("path", "content").write.format(NAME).mode("append").save(path)


def read_events(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """The events of a file or folder, with chunk-level pushdown of comparisons."""
    register(spark)
    return spark.read.format(NAME).option("rows", "events").option("splitBytes", split).load(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of a file or folder, from their headers alone."""
    register(spark)
    return spark.read.format(NAME).option("rows", "chunks").load(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, segment, held = ch.arrow(ch.ROWS), None, []
    for batch in batches:
        for row in batch.to_pylist():
            if segment is None or segment.path != row["path"]:
                if segment is not None:
                    segment.close()
                segment = Segment(row["path"])
            held += segment.events(row)
            while len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held[:ROWS], schema=schema)
                held = held[ROWS:]
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """The events of catalogued chunks, each read by its offset; chunks that lie together in a file are read by one task."""
    whole = chunks.where("problem is null and core_id is not null").select("path", "chunk_id", "payload_offset", "payload_size", "records", "crc")
    near = whole.repartition("path", F.floor(F.col("payload_offset") / SPLIT_BYTES)).sortWithinPartitions("path", "payload_offset")
    return near.mapInArrow(_read, ch.ROWS)


def read_spans(chunks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events inside the spans, counters per path) from a catalogue; only chunks that a span touches are read.

    spans: path, core_id, t_begin, t_end, seq_begin, seq_end (nulls: any seq), and refs
    (array of wanted event refs ``core:seq``, null: all events of the span).
    Counters: chunks, seeks (chunks read), bytes (their headers and payloads), span_total (times
    spanned), decoded, kept, target_refs, missed_refs and hit_rate, the share of target refs found (1 if none is wanted).
    """
    known, wanted = settle(chunks), settle(spans)
    touched = settle(ch.touched_chunks(known, wanted.drop("refs")))
    decoded = settle(read_chunks(known.join(touched.select("path", "chunk_id"), ["path", "chunk_id"], "left_semi")).where("problem is null"))
    inside = ch.inside_spans(decoded, wanted)
    kept = inside.withColumn("ref", F.concat_ws(":", "core_id", "seq")).where("refs is null or array_contains(refs, ref)")
    kept = settle(kept.select("path", "core_id", "seq", "ts_raw", "event_name", "task_id", "ref").distinct())
    targets = wanted.select("path", F.explode("refs").alias("ref")).distinct()
    missed = targets.join(kept, ["path", "ref"], "left_anti").groupBy("path").agg(F.count("*").alias("missed_refs"))
    counts = known.groupBy("path").agg(F.count("*").alias("chunks"))
    counts = counts.join(touched.groupBy("path").agg(F.count("*").alias("seeks"), (F.sum("payload_size") + F.count("*") * CHUNK_HEADER.size).alias("bytes")), "path", "left")
    counts = counts.join(wanted.groupBy("path").agg(F.sum(F.col("t_end") - F.col("t_begin")).alias("span_total")), "path", "left")
    for part, name in ((decoded, "decoded"), (kept, "kept"), (targets, "target_refs")):
        counts = counts.join(part.groupBy("path").agg(F.count("*").alias(name)), "path", "left")
    counts = counts.join(missed, "path", "left").na.fill(0)
    hit = F.when(F.col("target_refs") == 0, 1.0).otherwise(F.round((F.col("target_refs") - F.col("missed_refs")) / F.col("target_refs"), 6))
    return kept.drop("ref"), counts.withColumn("hit_rate", hit)
