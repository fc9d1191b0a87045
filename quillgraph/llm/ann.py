"""Approximate nearest neighbours by stable projections and a kd-tree with a chi-square stopping test.

Largest inner product becomes least distance by one more coordinate, sqrt(M**2 - |x|**2), where M is the
largest norm (0 for queries). The longer vectors are projected on M_DIMS Gaussian (2-stable) directions: for
points at distance d the squared projected distance over d**2 follows a chi-square law with M_DIMS degrees
of freedom. A kd-tree over the projected points of a bounded sample divides the space of all of them into leaves.
A query goes through the leaves by projected distance, in rounds of ever more leaves; the vectors in a leaf are
verified by exact inner products, and it stops when a neighbour nearer than its k-th best would have been met
already with probability CONFIDENCE.

All rows are indexed. Leaves are worked on in blocks of points and of queries, so neither a leaf that holds very
many (equal) points nor one that very many queries come to passes one task. Only the k best of a query and block
leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K = 20
M_DIMS = 8
CONFIDENCE = 0.8
#: Projected points that the tree is built from, about, points for a leaf of it, and of all points in a leaf.
SAMPLE, SAMPLE_LEAF, LEAF = 65_536, 16, 512
#: Points, and queries, that meet in one task.
BLOCK, QUERY_BLOCK = 8_192, 2_048
#: Leaves of the first round, and by how much more each next one has.
FIRST_LEAVES, MORE = 2, 4


def chi_square_quantile(p: float, df: int) -> float:
    """x with P(chi-square with an even df <= x) = p, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return low


class Tree:
    """A kd-tree as splits: axis and cut of each inner node and its two children (a leaf is ~number)."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.cut, self.child, self.leaves = [], [], [], 0
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        span = points.max(0) - points.min(0) if len(points) else np.zeros(M_DIMS)
        if len(points) <= leaf or span.max() <= 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        axis = int(span.argmax())
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] <= cut
        if low.all():
            low = points[:, axis] < cut
            cut = float(points[low, axis].max())
        node = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append(None)
        self.child[node] = (self._grow(points[low], leaf), self._grow(points[~low], leaf))
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), self.root, np.int64)
        if self.root < 0:
            return ~out
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        open_ = np.arange(len(points))
        while len(open_):
            node = out[open_]
            out[open_] = child[node, (points[open_, axis[node]] > cut[node]).astype(np.int64)]
            open_ = open_[out[open_] >= 0]
        return ~out


def directions(n: int) -> np.ndarray:
    """M_DIMS Gaussian directions for vectors of n components and the one that makes them longer."""
    return np.random.default_rng(20).standard_normal((n + 1, M_DIMS))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k best points for each query, ties to the smaller vec_id; only of those that
    are not worse than the query's k-th best so far (known), where it has one."""
    known = np.full(len(queries), -np.inf) if known is None else np.where(np.isnan(known), -np.inf, known)
    out = []
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ vectors.T
        for q, row in enumerate(rough, at):
            row[ids == query_ids[q]] = -np.inf
            least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            # products of matrices round by position, so what is near the last place is summed again, row by row
            least = max(least, known[q])
            some = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf)) if np.isfinite(least) else np.flatnonzero(row > -np.inf)
            score = np.einsum("ij,j->i", vectors[some], queries[q])
            some, score = some[score >= known[q]], score[score >= known[q]]
            top = np.lexsort((ids[some], -score))[:k]
            out += [(int(query_ids[q]), a, b) for a, b in zip(ids[some][top].tolist(), score[top].tolist())]
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part: not null nor zero, all components finite, and
    as many of them as most rows have (the smaller number on a tie); vec_id not null."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def nearest(embeddings: DataFrame, every: int = 20, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k nearest others found.

    Ties go to the smaller vec_id. Rows that repeat a vec_id count once (the vector that is least). An empty table
    gives none.
    """
    rows = usable(embeddings).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = saved(rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    spark = embeddings.sparkSession
    all_, most, dims = rows.agg(F.count("*"), F.max("square"), F.max(F.size("v"))).first()
    if not all_:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most, axes, limit = float(most), directions(dims), chi_square_quantile(confidence, M_DIMS)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.stack(f["v"].to_numpy()) if len(f) else np.zeros((0, dims))
            longer = np.sqrt(np.maximum(most - f["square"].to_numpy(), 0))
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "square": f["square"], "p": list(v @ axes[:-1] + longer[:, None] * axes[-1]), "q": list(v @ axes[:-1])})

    projected = saved(rows.mapInPandas(project, "vec_id long, v array<double>, square double, p array<double>, q array<double>"))
    share = int(math.ceil(min(1.0, SAMPLE / all_) * (1 << 20)))
    sample = projected.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("p").toPandas()["p"]
    sample = np.stack(sample.to_numpy()) if len(sample) else np.zeros((0, M_DIMS))
    tree = Tree(sample, max(SAMPLE_LEAF, int(math.ceil(LEAF * len(sample) / all_))))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = np.stack(f["p"].to_numpy()) if len(f) else np.zeros((0, M_DIMS))
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "p": f["p"], "leaf": tree.leaf_of(points).astype(np.int32)})

    points = saved(projected.select("vec_id", "v", "p").mapInPandas(place, "vec_id long, v array<double>, p array<double>, leaf int"))
    sides = [F.min(F.col("p")[i]).alias(f"low{i}") for i in range(M_DIMS)] + [F.max(F.col("p")[i]).alias(f"high{i}") for i in range(M_DIMS)]
    leaves = points.groupBy("leaf").agg(F.count("*").alias("n"), *sides).toPandas()  # at most SAMPLE / SAMPLE_LEAF of them
    numbers, parts = leaves["leaf"].to_numpy(), dict(zip(leaves["leaf"].tolist(), (-(-leaves["n"] // BLOCK)).tolist()))
    low, high = (leaves[[f"{side}{i}" for i in range(M_DIMS)]].to_numpy() for side in ("low", "high"))
    queries = saved(projected.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "q", "square"))
    best = None
    done, step = 0, FIRST_LEAVES
    while done < len(numbers):
        begin, end = done, done + step

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The leaves of this round that a query has not been stopped before."""
            for f in frames:
                out = []
                for query_id, q, square, kth in zip(f["query_id"].tolist(), f["q"], f["square"].tolist(), f["kth"].tolist()):
                    gap = np.maximum(np.maximum(low - q, q - high), 0)
                    near = np.einsum("ij,ij->i", gap, gap)
                    order = np.argsort(near, kind="stable")[begin:end]
                    if kth is not None and not math.isnan(kth):  # equal vectors differ by rounding
                        order = order[near[order] <= limit * max(1e-9 * (square + most), square + most - 2 * kth)]
                    out += [(query_id, leaf, kth) for leaf in numbers[order].tolist()]
                yield pd.DataFrame(out, columns=["query_id", "leaf", "kth"]).astype({"query_id": "int64", "leaf": "int32", "kth": "float64"})

        asked = queries.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            asked = queries.join(kth, "query_id", "left")
        visits = saved(asked.select("query_id", "q", "square", "kth").mapInPandas(route, "query_id long, leaf int, kth double"))
        crowd = {r["leaf"]: -(-r["n"] // QUERY_BLOCK) for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        if not crowd:
            break
        sizes = spark.createDataFrame([(leaf, parts[leaf], n) for leaf, n in crowd.items()], "leaf int, parts int, crowds int")
        own = points.select("vec_id", "v", "leaf").join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        own = own.select("vec_id", "v", "leaf", "part", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"))
        come = visits.join(queries.select("query_id", "v"), "query_id").join(F.broadcast(sizes), "leaf").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int"))
        come = come.select("query_id", "v", "kth", "leaf", "crowd", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(b):
                a = a.sort_values("vec_id")
                found = search(a["vec_id"].to_numpy(np.int64), np.stack(a["v"].to_numpy()), b["query_id"].to_numpy(np.int64), np.stack(b["v"].to_numpy()), k, b["kth"].to_numpy(np.float64))
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        key = ["leaf", "part", "crowd"]
        found = own.groupBy(*key).cogroup(come.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = saved(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        done, step = end, step * MORE
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", "rank", "vec_id", "score")
