"""Connected components: alternating star contraction, or one task where the edges are counted to be few."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.session import checkpoint

#: So many edges are joined up in one task (some 50 MB).
FEW = 1 << 18


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that can be reached.

    Each round points every larger neighbour at the least neighbour, then every node at its least smaller
    neighbour. Neighbours are never collected: minima are aggregated with partial sums and joined back.
    Rounds end when the edges no longer change; their number grows with the logarithm of the size.
    """
    links = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.limit(few + 1).count() <= few:
        kind = dict(links.dtypes)["a"]
        return links.coalesce(1).mapInArrow(_unite, f"node {kind}, root {kind}")
    while True:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = up.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = checkpoint(down.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if _mark(after) == _mark(links):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select("b", "b").distinct())
        links = after


def _unite(it):
    parent: dict = {}
    kind = None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in it:
        kind = batch.schema.field("a").type
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], ["node", "root"])


def _mark(links: DataFrame):
    h = F.xxhash64("a", "b")
    return links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first()
