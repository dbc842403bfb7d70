"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own, which only a local master can use."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracefold.scratch.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tracefold-")
        spark.conf.set("tracefold.scratch.dir", path)
    return path


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Later jobs then start from files that every executor can read, so a lost
    executor costs the tasks it ran and nothing before them; the shuffle files
    behind them go once they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
