"""The prefix trie of conversations, built over a range partitioning of their paths.

A conversation's path is the run of its turns' digests (16 bytes of MD5 over
role and text), so a prefix of turns is a prefix of bytes and sorted paths put
every node's members next to each other.

* Equal paths are combined first, on the map side too; only distinct paths go on.
* Distinct paths are dealt to shards by ranges. Where one shard ends and the
  next begins, the two paths share some turns: the splitter paths. Their
  trie, the skeleton, is broadcast; a node is in the skeleton iff it has
  members in several shards.
* A shard walks its sorted paths with a stack and finishes every other node.
  Of skeleton nodes it gives partial aggregates over its own paths. All of
  them are sums and minima: a skeleton node's text is counted off once, by the
  first shard that holds it, and each shard adds its own members' share to all
  nodes above. So one reduction by node ends them, without a pass over the tree.
* Children of skeleton nodes get their parent's smallest member by a join.

Memory: a task holds the stack of one path and, for each node on it, the
finished children of a node that lies in one shard. Shards have about
``shard_paths`` paths; there are at most MOST_SHARDS, and no more than keep the
paths at both ends of all shards under END_BYTES, which bounds what the driver
and the broadcast hold. A conversation is one row of 20 bytes a turn.

Defined results: a null conv_id belongs to no conversation; turns of one
number are ordered by role, then by the digest; null role and text are empty;
an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

TURN = 16
MOST_SHARDS, END_BYTES = 4096, 64 << 20
#: So many skeleton nodes at most are broadcast to their children; beyond, the join is shuffled.
FEW_NODES = 200_000
IDS = 65_536


def paths_of(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns (in order, each a hex digest and the bytes of its text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    kept = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    # fields of structs sort nulls first
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return kept.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Per conversation c: conv_id, turns: the first crc32(c) % ``most`` turns of conversation c - c % ``group``, then c's own after as many."""
    own = paths_of(conversations)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    own = settle(own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor")))
    heads = own.where("conv_id = donor").select("donor", F.slice("turns", 1, most - 1).alias("head"))
    both = own.join(heads, "donor", "left")
    begin = F.when(F.col("head").isNull(), F.array().cast(both.schema["head"].dataType)).otherwise(F.expr("slice(head, 1, h)"))
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return both.select("conv_id", F.concat(begin, rest).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from its pieces of ids, sorted by path and piece: the hash runs on from piece to piece."""
    path, sizes, n, least, digest = None, None, 0, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.binary()), "bytes": pa.array([sizes], pa.list_(pa.int32())), "n": [n], "low": [least], "ends": [digest.hexdigest()]})

    for batch in batches:
        for new, bytes_, k, low, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new != path:
                if path is not None:
                    yield row()
                path, sizes, n, least, digest = new, bytes_, 0, low, hashlib.sha256()
            else:
                digest.update(b",")
            n, least = n + k, min(least, low)
            digest.update(ids.encode())
    if path is not None:
        yield row()


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """Per distinct path: path (binary), bytes (of each turn's text), n (conversations), low (smallest conv_id), ends (SHA-256 of all of them)."""
    rows = conversations.select(F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.bytes").alias("bytes"), "conv_id")
    # a group holds the ids of one piece: IDS at most, or twice as many around 0
    pieces = rows.groupBy("path", F.expr(f"conv_id div {IDS}").alias("piece")).agg(F.first("bytes").alias("bytes"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("path", "piece", "bytes", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("low"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    told = pieces.repartition("path").sortWithinPartitions("path", "piece").select("path", "bytes", "n", "low", "ids")
    return told.mapInArrow(_ends, "path binary, bytes array<int>, n bigint, low bigint, ends string")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many whole turns two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * TURN] == b[: middle * TURN] else (low, middle - 1)
    return low


def splitters(ends: list[tuple[int, bytes, bytes]]) -> dict[int, tuple[bytes | None, bytes | None]]:
    """Of each shard: what its first path shares with the shard before, and its last path with the one behind; null where there is none."""
    if not ends:
        return {}
    ends = sorted(ends)
    cut = [a[2][: TURN * shared_turns(a[2], b[1])] for a, b in zip(ends, ends[1:], strict=False)]
    return {s: (before, behind) for (s, _, _), before, behind in zip(ends, [None, *cut], [*cut, None], strict=True)}


class Node:
    """An open node: sums over the paths of this shard that pass it, and finished children that wait for its smallest member."""

    __slots__ = ("bytes", "children", "ends", "key", "leaves", "low", "n", "saved", "skeleton", "waiting")

    def __init__(self, key: bytes, size: int, skeleton: bool):
        self.key, self.bytes, self.skeleton = key, size, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.low = self.ends = None
        self.waiting: list[tuple] = []


FIELDS = "key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, skeleton boolean"
ARROW = pa.schema([("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string()), ("skeleton", pa.bool_())])


def walk(rows: Iterator[tuple[bytes, list[int], int, int, str]], before: bytes | None, behind: bytes | None) -> Iterator[tuple]:
    """The rows of FIELDS of one shard from its sorted distinct paths."""
    stack: list[Node] = []
    last, left, right = b"", 0, 0

    def close() -> Iterator[tuple]:
        node = stack.pop()
        depth = len(stack)
        # the first shard that holds a skeleton node counts it once: as a child, and less one copy of its text
        own = not node.skeleton or before is None or depth > left
        leaf = not node.skeleton and not node.children
        node.leaves += leaf
        node.saved += (node.n - own) * node.bytes
        parent = stack[-1] if stack else None
        if parent is not None:
            parent.children += own
            parent.n, parent.leaves, parent.saved = parent.n + node.n, parent.leaves + node.leaves, parent.saved + node.saved
            parent.low = node.low if parent.low is None else min(parent.low, node.low)
        row = (node.key, parent and parent.key, depth, node.low, None, node.n, node.children, node.leaves, node.saved, node.ends, node.skeleton)
        for child in node.waiting:
            yield (*child[:4], node.low, *child[5:])
        if parent is None or node.skeleton or parent.skeleton:
            yield row
        else:
            parent.waiting.append(row)

    for path, sizes, n, low, ends in rows:
        common = shared_turns(last, path) if stack else -1
        while len(stack) > common + 1:
            yield from close()
        left = shared_turns(path, before) if before is not None else 0
        right = shared_turns(path, behind) if behind is not None else 0
        split = max(left, right)
        for depth in range(len(stack), len(path) // TURN + 1):
            key = hashlib.md5(stack[-1].key + path[TURN * (depth - 1) : TURN * depth]).digest() if depth else b""
            stack.append(Node(key, sizes[depth - 1] if depth else 0, depth <= split))
        top = stack[-1]
        top.n, top.low, top.ends = top.n + n, low if top.low is None else min(top.low, low), ends
        last = path
    while stack:
        yield from close()


def _walk(splitter_paths) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitter_paths.value
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        row = next(rows, None)
        while row is not None:
            shard = row[0]

            def own() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[0] == shard:  # noqa: B023
                    yield row[1:]
                    row = next(rows, None)

            for node in walk(own(), *bounds[shard]):
                held.append(node)
                if len(held) >= 8192:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def prefix_trie(conversations: DataFrame, shard_paths: int = 50_000) -> DataFrame:
    """conversations: (conv_id, turns), as ``rebuilt`` or ``paths_of`` give them. Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    distinct = settle(distinct_paths(conversations))
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("path")), F.lit(0)).alias("longest")).first()
    at_hand = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, min(MOST_SHARDS, max(at_hand, -(-size["n"] // shard_paths)), END_BYTES // (2 * max(size["longest"], 1))))
    dealt = settle(distinct.repartitionByRange(n_shards, "path").select(F.spark_partition_id().alias("shard"), "*"))
    ends = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect()
    bounds = splitters([(r["shard"], bytes(r["first"]), bytes(r["last"])) for r in ends])
    shared = spark.sparkContext.broadcast(bounds)
    ordered = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "path")
    nodes = settle(ordered.mapInArrow(_walk(shared), FIELDS))

    done = nodes.where("not skeleton").drop("skeleton")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    skeleton = nodes.where("skeleton").groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends").alias("ends"))
    skeleton = settle(skeleton.select(*done.columns))
    parents = skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    if 1 + sum(len(before or b"") // TURN for before, _ in bounds.values()) <= FEW_NODES:
        parents = F.broadcast(parents)
    known, asked = done.where("parent_conv_id is not null"), done.where("parent_conv_id is null").unionByName(skeleton)
    asked = asked.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*done.columns)
    ends_sha = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return known.unionByName(asked).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha)
