"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are dealt by id range to groups, and a group is cut into blocks of
BLOCK vectors, each with its forward index (the vectors) and, per dimension,
its largest and smallest value; so has each group as a whole. The bound of a
query and a block, or group, is the sum over the dimensions of the query's
value times the extreme of the sign that makes it largest.

1. Every query meets the groups' extremes, in packs of PACK groups, and is
   sent to the group of largest bound of each pack. That gives it a first k-th
   best score.
2. Every query meets the extremes again and is sent to those other groups
   whose bound reaches its k-th score; the rest are never read for it.
3. Within a group a query's blocks are ordered by their bound and scored until
   the next bound is below the k-th best score. Ranks are then given per
   query, with the smaller id first in ties.

A task holds one group, or the extremes of one pack, at a time; queries stream
past in blocks, so memory does not follow their number, and above SPLIT
queries a group or pack is copied to several tasks. Rows that repeat both id
and vector are one entry with a count.

Defined results: vectors that are null or have null or non-finite components
take no part, nor do rows with a null vec_id; rows that repeat a vec_id are
candidates and queries of their own, and a query leaves out itself alone, not
its copies; shorter vectors are padded with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle

BLOCK, GROUP, QUERY_BLOCK, PACK = 256, 8192, 1024, 1024
#: Queries that one task takes through a group or a pack.
SPLIT = 65_536
#: kind 0: a block (ids, how often each), 1: queries (numbers, ids, least scores), 2: the extremes of a group.
PACKED = "grp int, kind int, n int, ids binary, own binary, least binary, vectors binary"
_SCHEMA = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("own", pa.binary()), ("least", pa.binary()), ("vectors", pa.binary())])
_NONE = np.zeros(0, np.float64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _row(grp: int, kind: int, ids: np.ndarray, own: np.ndarray, least: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    made = [grp, kind, len(ids), ids.astype(np.int64).tobytes(), own.astype(np.int64).tobytes(), least.astype(np.float64).tobytes(), vectors.astype(np.int64).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _numbers(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def _pack_blocks(dim: int) -> Callable:
    """(vec_id, copies, v) rows of one group to its blocks and its extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, high, low = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = _matrix(part.column(2), dim)
                high = vectors.max(axis=0) if high is None else np.maximum(high, vectors.max(axis=0))
                low = vectors.min(axis=0) if low is None else np.minimum(low, vectors.min(axis=0))
                yield _row(group, 0, _numbers(part, 0), _numbers(part, 1), _NONE, vectors)
        if high is not None:
            yield _row(group, 2, np.zeros(2), _NONE, _NONE, np.array([high, low]))

    return run


def _pack_queries(dim: int) -> Callable:
    """(q, vec_id, least, v) rows to blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                yield _row(0, 1, _numbers(part, 0), _numbers(part, 1), _numbers(part, 2), _matrix(part.column(3), dim))

    return run


def _read(row: dict, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64), np.frombuffer(row["least"], np.float64), np.frombuffer(row["vectors"], np.int64).reshape(-1, dim).astype(kind)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector of a block scores higher."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _route(dim: int, kind: type, best: bool) -> Callable:
    """Streams a pack's extremes and then queries; sends each query to its best group of the pack, or to the others whose bound reaches its least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, groups, ends = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["pack"], row["salt"]) != pack:
                    pack, groups, ends = (row["pack"], row["salt"]), [], []
                ids, own, least, vectors = _read(row, dim, kind)
                if row["kind"] == 2:
                    groups.append(row["grp"])
                    ends.append(vectors)
                elif groups:
                    high, low = np.stack(ends, 1)
                    b = bounds(vectors, high, low)
                    first = b.argmax(axis=1)
                    for g, grp in enumerate(groups):
                        to = np.flatnonzero(first == g if best else (first != g) & (b[:, g] >= least))
                        if len(to):
                            yield _row(grp, 1, ids[to], own[to], least[to], vectors[to])

    return run


def best_of(query: np.ndarray, own: int, blocks: list[tuple], limits: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
    """The k best (-score, id) of a query in a group's blocks, without itself, as far as they reach ``least``."""
    best: list[tuple[int, int]] = []
    for b in np.argsort(-limits, kind="stable").tolist():
        if limits[b] < least or (len(best) == k and limits[b] < -best[-1][0]):
            break
        ids, copies, vectors = blocks[b]
        scores = vectors @ query
        same = ids == own
        if same.any():
            copies = copies - (same & (vectors == query).all(axis=1))
        some = np.flatnonzero((copies > 0) & (scores >= least))
        order = some[np.lexsort((ids[some], -scores[some]))[:k]]
        best = sorted(best + [(-int(scores[i]), int(ids[i])) for i in order for _ in range(min(k, int(copies[i])))])[:k]
    return best


def _search(k: int, dim: int, kind: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, ends = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                if (row["grp"], row["salt"]) != group:
                    group, blocks, ends = (row["grp"], row["salt"]), [], None
                ids, own, least, vectors = _read(row, dim, kind)
                if row["kind"] == 0:
                    blocks.append((ids, own, vectors))
                    continue
                if ends is None:
                    ends = np.array([v.max(axis=0) for _, _, v in blocks]), np.array([v.min(axis=0) for _, _, v in blocks])
                limits = bounds(vectors, *ends)
                for i, q in enumerate(ids.tolist()):
                    out += [(q, found, -score) for score, found in best_of(vectors[i], int(own[i]), blocks, limits[i], k, least[i])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["q", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries (rows of vectors): (vec_id bigint, v array<bigint>). Returns query_id, rank (from 1), vec_id, score."""
    known = lambda df: df.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    vectors, queries = settle(known(vectors)), settle(known(queries).withColumn("q", F.monotonically_increasing_id()))
    size, peak = F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    told = vectors.agg(F.count("*").alias("n"), size.alias("dim"), peak.alias("peak")).first()
    dim = max(told["dim"] or 0, queries.agg(size.alias("dim")).first()["dim"] or 0, 1)
    # doubles add whole numbers below 2**53 exactly
    kind = np.float64 if dim * float(told["peak"] or 0) ** 2 < 2**53 else np.int64
    groups = max(1, -(-told["n"] // GROUP))
    order = ["vec_id", F.xxhash64("v")]
    dealt = vectors.select("vec_id", "copies", "v").repartitionByRange(groups, *order).sortWithinPartitions(*order)
    stored = settle(dealt.mapInArrow(_pack_blocks(dim), PACKED))
    blocks, extremes = stored.where("kind = 0"), stored.where("kind = 2").withColumn("pack", F.expr(f"grp div {PACK}").cast("int"))
    packs = -(-groups // PACK)

    salts = max(1, -(-queries.count() // SPLIT))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def found(asked: DataFrame, best: bool) -> DataFrame:
        rows = asked.mapInArrow(_pack_queries(dim), PACKED).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        met = extremes.withColumn("salt", spread).unionByName(rows).repartition("pack", "salt").sortWithinPartitions("pack", "salt", F.desc("kind"))
        sent = settle(met.mapInArrow(_route(dim, kind, best), PACKED))
        splits = settle(sent.groupBy("grp").agg(F.ceil(F.sum("n") / SPLIT).alias("splits")))
        held = blocks.join(splits, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("splits") - 1)))
        split = sent.join(splits, "grp").withColumn("salt", F.pmod(F.xxhash64("ids"), "splits"))
        streams = held.unionByName(split).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "kind")
        return settle(streams.mapInArrow(_search(k, dim, kind), "q bigint, vec_id bigint, score bigint"))

    lowest = F.lit(float("-inf"))
    first = found(queries.select("q", "vec_id", lowest.alias("least"), "v"), best=True)
    kth = first.groupBy("q").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double").alias("least"))
    second = found(queries.join(kth, "q", "left").select("q", "vec_id", F.coalesce("least", lowest).alias("least"), "v"), best=False)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    asked = queries.select("q", F.col("vec_id").alias("query_id"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return asked.join(ranked, "q").select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors whose components are all finite; v is null for the others."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, ints).alias("v"))
