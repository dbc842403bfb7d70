"""The registered training-data queries: thin digests over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_cnn, sql
from .chat_format import preference_format, with_foreign_reply
from .decontaminate import decontaminate
from .fill_middle import fill_in_middle, restored
from .html_extract import extract
from .langid import fit, held_out, identify
from .line_dedup import line_dedup
from .mixing import mix_summary
from .near_dedup import near_duplicates
from .prefix_trie import prefix_trie, rebuilt
from .secret_scan import listed, secret_scan
from .substring_dedup import substring_dedup
from .topk import quantised, top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_summary(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, repeat=2.0)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=75)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"), repository="doc_id", owner="source")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(name) for k, name in enumerate(("n_assign", "n_access", "n_hex"))]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), "n_live", "n_example")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another conversation's last reply (``with_foreign_reply``)."""
    return preference_format(with_foreign_reply(table(spark, sf_dir, "conversations")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_cnn.score(docs.select("doc_id", "text"), network)
    return out.select("row.doc_id", quality_cnn.held_out("row.doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_mix_sources, op3_html_extract, op4_language_id, op5_top_k, op6_near_duplicates, op7_secret_scan, op8_substring_dedup, op9_preference_format, op10_line_dedup, op11_fill_in_middle, op12_prefix_trie, op13_quality_cnn)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
