"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. The mix takes ``share`` times all words. Sources share that by
   weight; a source stops at ``repeat`` times its own words and the excess
   goes to the others by weight until none is above.
2. Blocks. Each source's documents stand in a seeded permuted order, laid
   end to end and cut into blocks of about ``block_words`` words (small
   sources: into at least LEAST_BLOCKS). The pool has every block once for each
   pass over the source that ``repeat`` allows, more than the mix will draw.
3. Splitting tree. The exact block quotas of all sources are split in two by
   a multivariate hypergeometric draw, each half again, and so on, until one
   vector of quotas is left for every output shard.
4. Draw. A source's pool is ranked by a seeded hash, pass by pass; the tree's
   leaves take disjoint runs of these ranks, as many as their quotas, and the
   blocks beyond the quotas are never drawn. The last block drawn is cut, so
   the words taken are the rounded target. Pieces of a shard then get a seeded
   random order; ``mixed_texts`` gives their texts, ``write_shards`` the files.

Texts are read once, for their word counts; all else works on counts until
texts are asked for. Orders are prefix-summed in hash buckets, so no source,
however large, meets in one task. All draws come from hashes of the seed and
of whole rows, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own,
last in order; weights repeat over the ordered sources; an empty table or one
without words gives targets of 0; repeated rows are taken separately. Where a
source's words aren't a multiple of its block length, its one shorter block
is the last of every pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, next_power_of_two, settle

BUCKETS, RANK_BUCKETS = 1024, 4096
#: Least number of blocks of a source with as many words; rows of the pool that one task makes from one row; tree nodes that one task splits.
LEAST_BLOCKS, CHUNK, TREE_ROWS = 64, 65_536, 1024


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def let(name: str, value: str, body: str) -> str:
    """SQL that binds ``name`` to ``value`` within ``body``, so that it is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(u: str, total: str, good: str, drawn: str) -> str:
    """SQL for a hypergeometric draw by inversion of ``u``: how many of ``drawn`` from ``total`` are among ``good``.

    The probabilities follow from their ratios, from 12 standard deviations
    below the mean to 12 above (or the ends of the support), and need no
    factorials.
    """
    share = f"(cast({good} as double) / greatest({total}, 1L))"
    sd = f"sqrt(greatest(0D, {drawn} * {share} * (1 - {share}) * ({total} - {drawn}) / greatest({total} - 1, 1L)))"
    moments = f"named_struct('mean', {drawn} * {share}, 'sd', {sd})"
    ends = (
        f"named_struct('lo', greatest(0L, {drawn} + {good} - {total}, cast(floor(d.mean - 12 * d.sd - 12) as bigint)),"
        f" 'hi', least({drawn}, {good}, cast(ceil(d.mean + 12 * d.sd + 12) as bigint)))"
    )
    ratio = f"(cast({good} - k as double) * ({drawn} - k) / (cast(k + 1 as double) * ({total} - {good} - {drawn} + k + 1)))"
    mass = f"aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 'sum', 0D), (s, k) -> named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w), s -> s.sum)"
    below = (
        "aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 'sum', 0D, 'x', 0L),"
        f" (s, k) -> named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w, 'x', s.x + if(s.sum + s.w <= goal, 1L, 0L)), s -> s.x)"
    )
    return let("d", moments, let("r", ends, let("goal", f"{u} * {mass}", f"least(r.hi, r.lo + {below})")))


def targets(sources: DataFrame, weights: Sequence[float], share: float, repeat: float) -> DataFrame:
    """Adds rank, weight and target to one row per source (key, source_size).

    With sources ordered by the multiple of their weight at which they are
    full, the full ones are a prefix; ``level`` is what one unit of weight
    gets when all before a row are full.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", F.get(ws, F.pmod("rank", F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = ranked.withColumn("level", left / weight).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(every)["level"]
    return leveled.withColumn("rest", rest).select("key", "source_size", "rank", F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From one row (q: array of block counts) to shard, q, off: each shard's counts and where its draws start."""
    nodes = quotas.select(F.lit(0).alias("shard"), "q", F.transform("q", lambda _: F.lit(0).cast("bigint")).alias("off"))
    width = shards
    while width > 1:
        if shards // width == TREE_ROWS:
            nodes = nodes.repartition("shard")
        width //= 2
        draw = hypergeometric(f"(pmod(xxhash64({seed}, {width}, shard, e.i), 4503599627370496L) / 4503599627370496D)", "a.total", "e.g", "a.draw")
        whole = "aggregate(q, 0L, (s, g) -> s + g)"
        state = f"named_struct('total', {whole}, 'draw', {whole} div 2, 'out', cast(array() as array<bigint>))"
        step = let("x", draw, "named_struct('total', a.total - e.g, 'draw', a.draw - x, 'out', concat(a.out, array(x)))")
        left = F.expr(f"aggregate(transform(q, (g, i) -> named_struct('g', g, 'i', i)), {state}, (a, e) -> {step}, a -> a.out)")
        nodes = nodes.withColumn("left", left).select(
            F.explode(
                F.array(
                    F.struct(F.col("shard"), F.col("left").alias("q"), F.col("off")),
                    F.struct((F.col("shard") + width).alias("shard"), F.zip_with("q", "left", lambda a, b: a - b).alias("q"), F.zip_with("off", "left", lambda a, b: a + b).alias("off")),
                )
            ).alias("n")
        ).select("n.*")
    return nodes


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds h, a hash that tells the different rows of one doc_id apart."""
    return docs.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")))


def ranked_pool(aims: DataFrame, passes: int, seed: int) -> DataFrame:
    """key, pass, block, draw: every block of every pass, and its place in the source's seeded order; passes follow each other."""
    chunks = aims.where("n_blocks > 0").select("key", "n_blocks", F.expr("n_blocks * block_length > source_size").alias("uneven"), F.explode(F.expr(f"sequence(0L, n_blocks - 1, {CHUNK}L)")).alias("at"))
    chunks = chunks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).repartition("key", "at", "pass")
    pool = chunks.select("key", "n_blocks", "pass", "uneven", F.explode(F.expr(f"sequence(at, least(at + {CHUNK}, n_blocks) - 1)")).alias("block"))
    pool = pool.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "key", "pass", "block"), F.lit(1 << 52)))
    last = F.col("uneven") & (F.col("block") == F.col("n_blocks") - 1)
    pool = pool.withColumn("bucket", F.when(last, F.lit(RANK_BUCKETS)).otherwise(F.floor(F.col("u") / ((1 << 52) // RANK_BUCKETS)).cast("int")))
    sizes = pool.groupBy("key", "pass", "bucket").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(W.partitionBy("key", "pass").orderBy("bucket")) - F.col("k")).drop("k")
    within = F.row_number().over(W.partitionBy("key", "pass", "bucket").orderBy("u", "block"))
    placed = pool.withColumn("within", within).join(before, ["key", "pass", "bucket"])
    return placed.select("key", "pass", "block", (F.col("pass") * F.col("n_blocks") + F.col("before") + F.col("within") - 1).alias("draw"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    repeat: float = 2.0,
    block_words: int = 4096,
    shard_words: int = 4_000_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: one row per row of ``docs``: row (its identity: source key,
    bucket, place), doc_id, source, size, source_size, target.
    pieces: what the mix takes: row, doc_id, h, shard, shard_order (random
    order within the shard), source_block, pass (0 for the first pass over
    the source), first and last (its words, from 0, last exclusive), words.
    """
    sized = keyed(docs, seed).select(
        "doc_id",
        "source",
        "h",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))))
    sized = settle(sized.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))

    bucket_sizes = sized.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    aims = targets(bucket_sizes.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, share, repeat)
    wanted = F.greatest(F.ceil(F.col("source_size") / block_words), F.least(F.lit(LEAST_BLOCKS), "source_size"))
    aims = aims.withColumns({"aim": F.round("target").cast("long"), "block_length": F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), wanted))).cast("long")})
    aims = aims.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_length")).cast("long"))
    whole = F.expr("aim div greatest(source_size, 1L)")
    aims = settle(aims.withColumn("quota", whole * F.col("n_blocks") + F.ceil((F.col("aim") - whole * F.col("source_size")) / F.col("block_length")).cast("long")))
    starts = bucket_sizes.withColumn("bucket_start", F.sum("bucket_size").over(W.partitionBy("key").orderBy("bucket")) - F.col("bucket_size"))
    starts = settle(starts.join(aims.select("key", "source_size", "target", "block_length"), "key").drop("bucket_size"))
    within = W.partitionBy("key", "bucket").orderBy("h", "doc_id")
    placed = sized.join(starts, ["key", "bucket"]).withColumns(
        {"place": F.row_number().over(within), "start": F.col("bucket_start") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")}
    )
    documents = placed.withColumn("row", F.struct("key", "bucket", "place"))

    # one row: as many counts as there are sources
    quotas = aims.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("quota").alias("n")))).alias("all"), F.sum("aim").alias("words"))
    words = quotas.first()["words"] or 0
    shards = split_quotas(quotas.select(F.transform("all", lambda s: s["n"]).alias("q")), next_power_of_two(words / shard_words), seed)
    leaves = settle(shards.select("shard", F.posexplode(F.arrays_zip("q", "off")).alias("rank", "d")).select("shard", "rank", "d.q", "d.off").where("q > 0"))
    draws = leaves.join(aims.select("rank", "key"), "rank").select("shard", "key", F.explode(F.expr("sequence(off, off + q - 1)")).alias("draw"))
    drawn = ranked_pool(aims, int(-(-repeat // 1)), seed).join(draws, ["key", "draw"]).join(aims.select("key", "aim", "quota", "n_blocks", "block_length", "source_size"), "key")
    low = F.col("block") * F.col("block_length")
    so_far = F.expr("(draw div n_blocks) * source_size + pmod(draw, n_blocks) * block_length")
    high = F.when(F.col("draw") == F.col("quota") - 1, low + F.col("aim") - so_far).otherwise(F.least(low + F.col("block_length"), "source_size"))
    drawn = drawn.select("key", F.col("block").alias("source_block"), "pass", "shard", low.alias("low"), high.alias("high"))

    blocks = documents.where("size > 0").select("row", "doc_id", "h", "key", "size", "start", F.explode(F.expr("sequence(start div block_length, (start + size - 1) div block_length)")).alias("source_block"))
    pieces = blocks.join(drawn, ["key", "source_block"]).select(
        "row",
        "doc_id",
        "h",
        "shard",
        F.xxhash64(F.lit(seed), "shard", "source_block", "pass", "row").alias("shard_order"),
        "source_block",
        "pass",
        (F.greatest("start", "low") - F.col("start")).alias("first"),
        (F.least(F.col("start") + F.col("size"), "high") - F.col("start")).alias("last"),
    )
    pieces = pieces.where("first < last").withColumn("words", F.col("last") - F.col("first"))
    return documents.select("row", "doc_id", "source", "size", "source_size", "target"), pieces


def mixed_texts(docs: DataFrame, pieces: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: shard, shard_order, doc_id, source, source_block, pass, text (the piece's words joined by one space), for the ``seed`` of the mix."""
    texts = keyed(docs, seed).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "source", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")).dropDuplicates(["_id", "_h"])
    both = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    text = F.array_join(F.slice("_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    return both.select("shard", "shard_order", "doc_id", "source", "source_block", "pass", text.alias("text"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Parquet files in which a shard's pieces stand together, in their random order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "shard_order").write.parquet(path)


def mix_summary(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, n_shards (shards that hold a part of it)."""
    documents, pieces = mix(docs, **options)
    own = documents.withColumns({"words": F.lit(0).cast("long"), "shard": F.lit(None).cast("int"), "own": F.lit(1)})
    parts = pieces.select("row", "words", "shard")
    every = own.unionByName(parts, allowMissingColumns=True)
    summed = every.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
        F.sum("words").alias("taken"),
        F.count_distinct("shard").alias("n_shards"),
    )
    return summed.drop("row")
