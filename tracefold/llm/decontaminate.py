"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's n-grams (``n`` consecutive words; a shorter item is one gram)
become a small table keyed by a 64-bit hash. Every document's windows are
hashed inside its row, exploded, probed against that table by a broadcast
hash join, and each hash hit is verified on the words themselves. Only hits
and one marker row per document are shuffled.

The grams are broadcast in pieces of at most ``PIECE`` rows; a larger
benchmark is probed piece by piece, so no broadcast grows with it.

Defined results: null or wordless text has no words and no hits; an empty
benchmark contaminates nothing; a null item id is named ``""``; items that
repeat an id count once; every input row gives one output row, rows that
repeat a doc_id and text included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, in_struct

GRAM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 500_000


def gram_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(GRAM_WORD), F.lit(0)), F.array().cast("array<string>"))


def window_hashes(hashes: str, length: int) -> Column:
    """The hash of each window of ``length`` words, from the column of the words' hashes.

    The column is named several times on purpose: an expression with one
    user is inlined, here into the lambda, where it would run once a window.
    """
    return F.when(
        F.size(hashes) >= length,
        F.transform(F.sequence(F.lit(1), F.size(hashes) - (length - 1)), lambda i: F.xxhash64(F.slice(F.col(hashes), i, length))),
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct grams: hash, length, words joined by one space, ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), gram_words(F.col("text")).alias("words"))
    items = items.withColumn("len", F.least(F.size("words"), F.lit(n))).where("len > 0")
    grams = items.select("item", "len", F.explode(F.expr("transform(sequence(1, size(words) - len + 1), i -> slice(words, i, len))")).alias("gram"))
    return grams.groupBy(F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("h"), F.col("len"), F.array_join("gram", " ").alias("gram")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The rows of ``decontaminate`` with text_hash, which tells texts of one doc_id apart."""
    grams = benchmark_grams(benchmark, n)
    # at most n rows: the distinct gram lengths, and how many grams there are
    sizes = {r["len"]: r["k"] for r in grams.groupBy("len").agg(F.count("*").alias("k")).collect()}
    lengths = sorted(sizes, reverse=True)
    pieces = max(1, -(-sum(sizes.values()) // PIECE))

    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), gram_words(F.col("text")).alias("words"))
    words = words.withColumn("n", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # element 0 is null and stands for the document itself
    windows = F.concat(F.array(F.lit(None).cast("bigint")), *[window_hashes("hashes", k) for k in lengths])
    rows = words.select("doc_id", "text_hash", "n", "words", F.posexplode(windows).alias("p", "h"))

    def start(length: Column) -> Column:
        """Where the window found at array place ``p`` starts, from 0."""
        at, out = F.lit(1), F.lit(None).cast("int")
        for k in lengths:
            out = F.when(length == k, F.col("p") - at).otherwise(out)
            at = at + F.greatest(F.col("n") - (k - 1), F.lit(0))
        return out

    def probe(i: int) -> DataFrame:
        piece = grams if pieces == 1 else grams.where(F.pmod("h", F.lit(pieces)) == i)
        piece = piece.select(F.col("h").alias("gram_h"), "len", "gram", "items")
        hit = rows.join(F.broadcast(piece), rows.h == piece.gram_h, "left").withColumn("start", start(F.col("len")))
        found = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("gram")
        own = F.col("p") == 0 if i == 0 else F.lit(False)
        return hit.where(own | found).select("doc_id", "text_hash", "n", "p", F.when(F.col("p") > 0, F.struct("start", "len")).alias("span"), "items")

    hits = reduce(DataFrame.unionByName, [probe(i) for i in range(pieces)])
    per_doc = hits.groupBy("doc_id", "text_hash", "n").agg(
        F.count(F.when(F.col("p") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr(
        "aggregate(spans, named_struct('seen', 0, 'hit', 0L), (a, s) -> named_struct('seen', greatest(a.seen, s.start + s.len),"
        " 'hit', a.hit + greatest(0, s.start + s.len - greatest(a.seen, s.start))), a -> a.hit)"
    )
    out = per_doc.select(
        "doc_id",
        "text_hash",
        F.col("n").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted array), contaminated."""
    return judged(docs, benchmark, n).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window; each text of a repeated or null doc_id is judged by itself."""
    bad = judged(docs, benchmark, n).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = docs.select(in_struct(docs).alias("row"), F.xxhash64("text").alias("hash"))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
