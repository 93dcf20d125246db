"""Connected components by alternating star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), longs; root is the least node that can be reached.

    Each round points every larger neighbour at the least neighbour (large star), then every node at
    its least smaller neighbour (small star). Neighbours are never collected: minima are aggregated
    with partial sums and joined back, so that a hub with many links is spread like any skewed join.
    Rounds end when the edge set no longer changes; the number grows with the logarithm of the size.
    """
    links = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = checkpoint(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if _mark(after) == _mark(links):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select("b", "b").distinct())
        links = after


def _mark(links: DataFrame):
    h = F.xxhash64("a", "b")
    return links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first()
