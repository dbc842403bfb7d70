"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, component), component being the smallest node reachable.

    Each step replaces a node's edges by edges to the smallest neighbour.
    Minima combine on the map side. They are written before they are joined
    back, so that both sides of the join are plain exchanges, which adaptive
    execution splits where a node has very many neighbours. Ends when a round
    changes nothing. Loops and null ends are ignored.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # large star: of each node, the larger neighbours move to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: of each node, the smaller neighbours and itself move to the smallest
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = settle(small)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = after
