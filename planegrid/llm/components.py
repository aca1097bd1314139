"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, narrowed, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component), the component being its smallest node.

    A round points every node at the smallest node around it, first the larger neighbours, then the
    smaller ones; the number of rounds grows with the logarithm of the longest chain. An empty table
    gives an empty one. A node with many neighbours is one group key of aggregations only. A round's tables
    have as many partitions as the edges before it need.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    seen = None
    while True:
        # n edges have 2 n nodes at most, and a round leaves 2 n edges at most
        small = 2 * n <= FEW
        pairs = narrowed(pairs, n)
        both = pairs.unionAll(pairs.select("b", "a"))
        low = cut(narrowed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n")), 2 * n))
        large = cut(narrowed(spread_join(both, low, "a", small=small).where("b > a").select(F.col("low").alias("a"), "b").distinct(), n))
        low = cut(narrowed(large.groupBy("b").agg(F.min("a").alias("low"), F.count(F.lit(1)).alias("n")), n))
        star = spread_join(large, low, "b", small=small)
        pairs = cut(narrowed(star.select(F.col("low").alias("a"), "b").union(star.where("a <> low").select("low", "a")).distinct(), 2 * n))
        n, *_ = now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = now
