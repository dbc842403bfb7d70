"""Near-duplicate detection: SuperMinHash signatures, banding, verification, union-find.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes).
   Texts with the same set form one class, a node named by the set's hash.
   Its head is the row of smallest doc_id, and of those the smallest text hash.
2. A SuperMinHash signature: every shingle throws its j-th value, in
   [j, j + 1), at the j-th slot of its own random permutation; once all slots
   hold values below j + 1 the rest of the throws can't matter and stop.
   BANDS bands of ROWS slots are hashed; at similarity 0.75 two texts share no
   band with probability below 2e-6, at 0.8 below 3e-9.
3. In each band bucket, all members are compared with the smallest one. Links
   are merged to components; members still in different components go on:
   buckets with few pairs between components have these compared, others go
   round by round with twice as many more leaders each time, until no bucket
   spans components. So a large group of copies costs a few comparisons a
   member, a bucket of m members that stay apart takes about log m rounds, and
   no pair that could join two components is left out.
4. Every comparison is made on the full shingle sets, recomputed from the
   two texts. Components come from star contraction.

Defined results: null, empty or wordless text has no shingles, links with
nothing and is its own component; fewer than five words are one shingle;
rows that repeat a doc_id and its text get the same result each, different
texts under one doc_id are told apart by a 64-bit hash; a null doc_id comes
after all others, and a component without other ids has the id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix64, rolling_hashes, string_slices, word_hashes, words
from .common import in_struct, settle
from .components import connected_components

K = 5
BANDS, ROWS = 50, 5
SLOTS = BANDS * ROWS
#: Most pairs between components per member of a bucket that are compared at once, and members compared with all in the first round otherwise.
PARTNERS, LEADERS = 4096, 64
#: Hash parts in which the shingles that two documents could share are counted.
PARTS = 128


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of all texts of a slice, where each text's begin)."""
    for row, end, offsets, data in string_slices(column):
        starts, ends, first = words(offsets, data)
        hashes = word_hashes(data, starts, ends, lower=True)
        runs = rolling_hashes(hashes, K)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= K:
                sets.append(np.unique(runs[a : b - K + 1]))
            elif b > a:
                sets.append(rolling_hashes(hashes[a:b], b - a))
            else:
                sets.append(runs[:0])
        bounds = np.zeros(end - row + 1, dtype=np.int64)
        np.cumsum([len(s) for s in sets], out=bounds[1:])
        yield row, np.concatenate(sets) if sets else runs[:0], bounds


def signatures(shingles: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: a row of ``slots`` values per text; a value's upper half is the throw, its lower half a random number."""
    n = len(bounds) - 1
    out = np.full((n, slots), ~U(0), dtype=U)
    text = np.repeat(np.arange(n), np.diff(bounds))
    active = shingles
    perm: np.ndarray | None = None
    picks: list[np.ndarray] = []
    for j in range(slots):
        if not len(active):
            break
        bits = mix64(active + U(((j + 1) * 0xD1342543DE82EF95) % 2**64))
        pick = (((bits & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64) + j
        if perm is None and j == 6:  # few are left: from here on their permutations are written out
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(active), 1))
            rows = np.arange(len(active))
            for t, p in enumerate(picks):
                perm[rows, t], perm[rows, p] = perm[rows, p], perm[rows, t].copy()
        if perm is None:  # follow the place back through the earlier swaps
            slot = pick
            for t in range(j - 1, -1, -1):
                slot = np.where(slot == t, picks[t], np.where(slot == picks[t], t, slot))
            picks.append(pick)
        else:
            rows = np.arange(len(active))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
        np.minimum.at(out.reshape(-1), text * slots + slot, (bits >> U(32)) | U(j << 32))
        going = (out.max(axis=1) >= U((j + 1) << 32))[text]
        if not going.all():
            active, text = active[going], text[going]
            picks = [p[going] for p in picks]
            perm = None if perm is None else perm[going]
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mix64(out * U(0x9E3779B97F4A7C15) + bands[:, :, r])
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.columns
        for row, shingles, bounds in shingle_sets(texts):
            n = np.diff(bounds)
            sums = np.zeros((2, len(shingles) + 1), dtype=U)
            np.cumsum(mix64(shingles), out=sums[0, 1:])
            np.cumsum(mix64(shingles ^ U(0xA5A5A5A55A5A5A5A)), out=sums[1, 1:])
            parts = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            bands = band_hashes(signatures(shingles, bounds)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(n)), hashes.slice(row, len(n)), pa.array(n), pa.array(parts[0]), pa.array(parts[1]), lists], names=["doc_id", "text_hash", "n", "s1", "s2", "bands"])


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256  # pairs at a time; a text that several of them share is read once
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)])
                _, first, place = np.unique(ids, return_index=True, return_inverse=True)
                texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
                sets = [s[b[i] : b[i + 1]] for _, s, b in shingle_sets(texts) for i in range(len(b) - 1)]
                keep = []
                for x, y in zip(place[: len(part)].tolist(), place[len(part) :].tolist(), strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(common > 0 and 100 * common >= threshold * (len(sets[x]) + len(sets[y]) - common))
                yield part.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 * intersection >= threshold * union."""
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_links(threshold), "a bigint, b bigint")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, shingles, bounds in shingle_sets(batch.column(1)):
            sizes = np.diff(bounds)
            owners = pa.array(np.repeat(np.arange(row, row + len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), batch.column(2).take(owners), pa.array(shingles.view(np.int64))], names=["doc", "component", "shingle"])


def usable(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, core, parts): how many of a document's shingles also stand in another component among ``docs`` (doc, component), in all and per hash part.

    Two documents of different components share at most the sum over the
    parts of the smaller count.
    """
    told = docs.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "text", "component")
    rows = told.mapInArrow(_shingle_rows, "doc bigint, component bigint, shingle bigint")
    common = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    counts = rows.join(common, "shingle", "left_semi").groupBy("doc", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").cast("int").alias("k"))
    filled = counts.groupBy("doc").agg(F.sum("k").alias("core"), F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("m"))
    return filled.select("doc", "core", F.expr(f"transform(sequence(0, {PARTS - 1}), i -> coalesce(try_element_at(m, i), 0))").alias("parts"))


def candidate_pairs(members: DataFrame, bands: DataFrame, texts: DataFrame, threshold: int, n_leaders: int) -> tuple[DataFrame, DataFrame]:
    """(pairs to compare, members for the next round) of buckets that span components.

    members: bucket, doc, n, component; bands: doc, bands. A pair comes from
    the first band that its documents share, and only if the shingles that
    they have in common with other components, counted by hash part, could
    reach the threshold; a stray copy mostly meets nobody. A bucket with at most
    PARTNERS pairs between components for each of its members gives them all
    and ends. Of the others, ``n_leaders`` members are compared with all and
    leave the bucket. A bucket's counts are written before they are joined back
    to its members, so that adaptive execution can split a large bucket.
    """

    def mixed(df: DataFrame) -> DataFrame:
        parts = df.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        stats = parts.groupBy("bucket").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("inside"), F.count("*").alias("parts")).where("parts > 1")
        return df.join(settle(stats.withColumn("few", F.expr(f"(size * size - inside) / 2 <= {PARTNERS} * size")).select("bucket", "few")), "bucket")

    spanning = settle(mixed(members).drop("few"))
    core = settle(usable(spanning.select("doc", "component").distinct(), texts))
    able = spanning.join(core, "doc").where(f"{100 + threshold} * core >= {threshold} * (n + {threshold} * n / 100)")
    open_ = settle(mixed(able))
    near = (
        f"x.bucket = y.bucket and x.component <> y.component and 100 * least(x.n, y.n) >= {threshold} * greatest(x.n, y.n)"
        f" and {100 + threshold} * least(x.core, y.core) >= {threshold} * (x.n + y.n)"
    )
    shared = f"aggregate(zip_with(x.parts, y.parts, (p, q) -> least(p, q)), 0, (s, v) -> s + v) * {100 + threshold} >= {threshold} * (x.n + y.n)"
    first = "x.bands[array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) - 1] = x.bucket"
    few = open_.where("few").join(bands, "doc")
    pairs = few.alias("x").join(few.alias("y"), F.expr(f"x.doc < y.doc and {near} and {first} and {shared}")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    many = open_.where("not few").drop("few").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(n_leaders)))
    leaders = many.groupBy("bucket", "salt").agg(F.min(F.struct("doc", "n", "component", "core", "parts")).alias("d")).select("bucket", "d.*")
    led = many.alias("x").join(leaders.alias("y"), F.expr(f"{near} and {shared}")).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
    rest = many.select("bucket", "doc", "n").join(leaders.select("bucket", "doc"), ["bucket", "doc"], "left_anti")
    return pairs.unionByName(led).distinct(), rest


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return judged(docs, threshold).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` that are kept, each text of a repeated or null doc_id by its own result."""
    gone = judged(docs, threshold).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(in_struct(docs).alias("row"), text_hash().alias("hash"))
    return rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def judged(docs: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``near_duplicates`` with text_hash, which tells texts of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    profiles = settle(texts.mapInArrow(_profiles, "doc_id bigint, text_hash bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = profiles.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(row).alias("head"))
    classes = settle(classes.select("s1", "s2", "n", F.xxhash64("s1", "s2", "n").alias("doc"), "head"))
    is_head = "text_hash = head.text_hash and doc_id <=> head.doc_id"

    chosen = profiles.where("n > 0").join(classes, ["s1", "s2", "n"]).where(is_head)
    rows = chosen.select("doc", "n", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("size")).where("size > 1").select("bucket", "leader")
    members = settle(rows.join(shared, "bucket"))
    involved = members.select("doc").distinct()
    heads = classes.join(involved, "doc", "left_semi").select("doc", "head")
    texts = settle(texts.join(heads, F.expr(is_head)).select(F.col("doc").alias("doc_id"), "text").dropDuplicates(["doc_id"]))

    bands = chosen.join(involved, "doc", "left_semi").select("doc", "bands").dropDuplicates(["doc"])
    first = members.alias("x").join(members.where("doc = leader").select("bucket", F.col("n").alias("leader_n")).alias("y"), "bucket")
    first = first.where(f"doc <> leader and 100 * least(n, leader_n) >= {threshold} * greatest(n, leader_n)").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    tested = settle(first)
    links = settle(verified(tested, texts, threshold))
    left = members.where("doc <> leader").select("bucket", "doc", "n")
    n_leaders = LEADERS
    while True:
        groups = connected_components(links)
        labelled = left.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("component", "doc").alias("component"))
        pairs, left = candidate_pairs(labelled, bands, texts, threshold, n_leaders)
        n_leaders *= 2
        pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"))
        left = settle(left)
        if pairs.isEmpty() and left.isEmpty():
            break
        tested = tested.unionByName(pairs)
        found = settle(verified(pairs, texts, threshold))
        if found.isEmpty() and left.isEmpty():
            break
        links = links.unionByName(found)

    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    grouped = settle(groups.unionByName(roots).withColumnRenamed("node", "doc").join(classes.select("doc", "head"), "doc"))
    # written, so that the join below can be split where one component is large
    first = settle(grouped.groupBy("component").agg(F.min("head").alias("first")))
    labels = grouped.select("doc", "component").join(first, "component").select("doc", "first")
    named = classes.join(labels, "doc", "left").select("s1", "s2", "n", F.coalesce("first", "head").alias("head"))
    out = profiles.select("doc_id", "text_hash", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    kept = F.col("head").isNull() | F.expr(is_head)
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("head.doc_id", "doc_id").alias("component_id"), kept.alias("kept"))
