"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each vector has M projections on random directions. A block of vectors keeps every projection sorted;
a query's window around its own projection widens by virtual rehashing (radius 1, c, c^2, ...), and a
vector that falls into a fixed share of the query's windows is verified by its exact distance, those
with most collisions first. A query ends when the k-th verified one is nearer than the distance at which
a vector would have been counted in these windows (SURE), or when k + FREE + BETA n of a block's n
vectors have been verified, or all. The same rule holds for blocks of all sizes.

Vectors and queries are dealt into blocks of bounded size, and each block of queries meets each block
of vectors in one task: stated queries against all rows, in blocks. Per block k neighbours of a query
leave a task; a window keeps the best k of all.

Defined cases: null vectors, zero vectors and such with null or non-finite components take no part;
neither do vectors of another length than the most common one's; a vector is never its own neighbour,
but rows that repeat its vec_id are other rows of the same id and do not count; fewer than k rows give
all; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, QUERY_EACH = 10, 100
#: Projections, the share of windows a candidate falls into, the ratio of radii, and the share of a block that the first windows hold.
M, SHARE, RATIO, FIRST = 256, 0.6, 1.15, 0.4
#: A query may verify k + FREE + BETA n of a block's n vectors.
BETA, FREE = 0.05, 100
#: A window of radius r holds a vector at distance r / SURE with a chance of 0.75, well over SHARE: such a one has been counted.
SURE = 1.15
VECTORS, QUERIES = 16384, 2048
SEED = 7


class Block:
    """The sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M):
        self.ids, self.vectors, self.repeats = ids, vectors, len(np.unique(ids)) < len(ids)
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], m))
        projected = vectors @ self.directions
        order = np.argsort(projected, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(projected.T, order, axis=1)
        # one array for all projections, each moved past the one before, so that one search serves all
        span = 4 * max(1e-12, float(np.abs(projected).max()))
        self.moved = span * np.arange(m)
        self.flat, self.order = (self.sorted + self.moved[:, None]).ravel(), order.astype(np.int32).ravel()
        self.first = len(ids) * np.arange(m)

    def search(self, own: int, query: np.ndarray, k: int = K, share: float = SHARE) -> list[tuple[int, float]]:
        n, m = len(self.ids), len(self.first)
        centre = query @ self.directions
        enough, need = min(n, k + FREE + int(BETA * n)), int(np.ceil(share * m))
        counts, done = np.zeros(n, np.int16), np.zeros(n, bool)
        end = self.first + n
        low = high = np.clip(np.searchsorted(self.flat, centre + self.moved), self.first, end)
        wide, at = int(FIRST * n / 2) + k, np.arange(m)
        far, near = np.minimum(n - 1, low - self.first + wide), np.maximum(0, low - self.first - wide)
        radius = max(float(np.median(self.sorted[at, far] - self.sorted[at, near])) / 2, 1e-12)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        self.verified = 0
        while True:
            a = np.minimum(low, np.clip(np.searchsorted(self.flat, centre - radius + self.moved, "left"), self.first, end))
            b = np.maximum(high, np.clip(np.searchsorted(self.flat, centre + radius + self.moved, "right"), self.first, end))
            for x, y in zip(np.append(a, high).tolist(), np.append(low, b).tolist(), strict=True):
                counts[self.order[x:y]] += 1  # a projection has each vector once
            low, high = a, b
            whole = bool((low == self.first).all() and (high == end).all())
            new = np.flatnonzero(~done & ((counts >= need) | whole))
            if len(new) > enough - self.verified and not whole:  # those that collide most come first
                most = np.argsort(-counts[new], kind="stable")[: max(0, enough - self.verified)]
                new = np.sort(new[(counts[new] >= counts[new[most]].min()) if len(most) else []])
            if len(new):
                done[new] = True
                self.verified += len(new)
                far = self.vectors[new] - query
                far, new = np.sqrt(np.einsum("ij,ij->i", far, far)), self.ids[new]
                far, new = far[new != own], new[new != own]
                if not self.repeats and len(far) > k:
                    near = far <= np.partition(far, k - 1)[k - 1]
                    far, new = far[near], new[near]
                ids, dist = np.concatenate([ids, new]), np.concatenate([dist, far])
                best = np.lexsort((ids, dist))
                ids, dist = ids[best], dist[best]
                if self.repeats:
                    at = np.sort(np.unique(ids, return_index=True)[1])
                    ids, dist = ids[at], dist[at]
                ids, dist = ids[:k], dist[:k]
            found = len(dist) == k and dist[-1] <= radius / SURE
            if whole or found or self.verified >= enough and len(dist) == k:
                return list(zip(ids.tolist(), dist.tolist(), strict=True))
            radius *= RATIO


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").limit(1).collect()
    return rows.where(F.size("v") == (length[0]["n"] if length else 0)).where("vec_id is not null")


def search(rows: DataFrame, k: int = K, query_each: int = QUERY_EACH, vectors: int = VECTORS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for every vector whose vec_id is divisible by query_each."""
    rows = usable(rows)
    asks = rows.where(F.col("vec_id") % query_each == 0).distinct()
    n = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_each == 0)).first()
    blocks, asked = max(1, -(-n[0] // vectors)), max(1, -(-n[1] // queries))
    deal = lambda df, k, other, other_k: df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(k)).cast("int").alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(other_k - 1))).alias("__o")).select("vec_id", "v", *([F.col("__b").alias("b"), F.col("__o").alias("q")] if other else [F.col("__o").alias("b"), F.col("__b").alias("q")]))
    left, right = deal(rows, blocks, True, asked), deal(asks, asked, False, blocks)

    def run(data: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if len(data) and len(ask):
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            block = Block(data["vec_id"].to_numpy(), matrix(data))
            for own, query in zip(ask["vec_id"].to_pylist(), matrix(ask), strict=True):
                out += [(own, i, d) for i, d in block.search(own, query, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
