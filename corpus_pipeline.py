"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
it kept. All but the last return the columns of documents. ``n_chars`` is
brought up to date where a stage changes the text. Texts that lose all their
lines stay, as empty documents; rows are only dropped by a stage's own rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import settle
from tracefold.llm.decontaminate import drop_contaminated
from tracefold.llm.langid import fit, held_out, identify
from tracefold.llm.line_dedup import line_dedup
from tracefold.llm.mixing import mix_summary
from tracefold.llm.near_dedup import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language is found for (null text, or text without a letter)."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).where("lang_pred <> 'und'").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows out of the texts."""
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return line_dedup(docs).select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_summary(docs, weights=(5.0, 2.0, 1.0), share=1.5, repeat=2.0)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: The fitted language model and the random draws of the mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
