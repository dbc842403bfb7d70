"""All registered queries over the trace operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import chunk_queries, evidence_queries, index_queries, metric_queries, rebuild_queries, stat_queries, stream_queries

BLOCKS = (chunk_queries, rebuild_queries, metric_queries, index_queries, evidence_queries, stat_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for block in BLOCKS for name, f in block.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for block in BLOCKS for name, text in block.ORACLE.items()}
