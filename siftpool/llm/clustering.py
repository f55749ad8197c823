"""Exact k-means on integer vectors by ball trees that partitions build for themselves.

Vectors are cut into blocks of bounded size, wherever they lie; each block becomes
one metric tree, written once as a row: its vectors in the order of the tree, and
for each ball its centre, radius, count and integer sum. A round sends the centroids
(k vectors) to all trees. A ball whose farthest point is nearer to one centroid than
its nearest point can be to any other goes to that centroid whole, by its count and
sum; others pass the centroids that are left to their two halves, and leaves compare
integers. What a round returns is one sum for each centroid and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import forget, written

DIMENSION = 64
SCALE = 64
BLOCK = 8192  # vectors of a tree at most
LEAF = 32  # vectors of a leaf at most, about
LARGEST = 1 << 26  # size of a component at which it is held, so that squared distances and sums of a block fit a long
_EXACT = 1 << 20  # below this, squared distances are exact in doubles
_MARGIN = 1e-9  # by which a bound has to hold, relative to the distances


@dataclass
class Tree:
    """A ball tree over integer vectors x, which are in the order of its leaves; ball i is split into balls 2i + 1 and 2i + 2.

    Balls of the last level are leaves. low and high are a ball's first vector and
    the one after its last; an empty ball has count 0.
    """

    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree and the order in which it holds the rows of x."""
        depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / LEAF))))
        n = (2 << depth) - 1
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        high[0] = len(x)
        order, floats = np.arange(len(x)), x.astype(float)
        for i in range(n // 2):
            a, b = low[i], high[i]
            own, middle = order[a:b], (a + b) // 2
            if b - a > 1:
                points = floats[own]
                apart = points - points.mean(axis=0)
                one = points[np.argmax(np.einsum("ij,ij->i", apart, apart))]
                apart = points - one
                other = points[np.argmax(np.einsum("ij,ij->i", apart, apart))]
                order[a:b] = own[np.argpartition(points @ (other - one), (b - a) // 2)]
            low[2 * i + 1], high[2 * i + 1], low[2 * i + 2], high[2 * i + 2] = a, middle, middle, b
        own = x[order]
        total = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(own, axis=0)))
        sums = total[high] - total[low]
        centre = sums / np.maximum(high - low, 1)[:, None]
        radius = np.zeros(n)
        for i in range(n):
            if high[i] > low[i]:
                apart = floats[order[low[i] : high[i]]] - centre[i]
                radius[i] = np.sqrt(np.einsum("ij,ij->i", apart, apart).max())
        return cls(own, low, high, centre, radius, sums), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """The centroid of each vector, the balls that went whole, as (ball, centroid), and the vectors that leaves compared."""
        n, k = len(self.low), len(centroids)
        cluster = np.zeros(len(self.x), np.int64)
        whole: list[tuple[int, int]] = []
        compared = []
        left = np.ones((1, k), bool)  # centroids that a ball's points may be nearest to
        level = np.array([0])
        while len(level):
            full = self.high[level] > self.low[level]
            level, left = level[full], left[full]
            apart = np.sqrt(np.maximum(((self.centre[level, None, :] - centroids[None, :, :]) ** 2).sum(axis=2), 0))
            apart[~left] = np.inf
            reach = apart.min(axis=1) + 2 * self.radius[level]
            left &= apart <= (reach * (1 + _MARGIN) + _MARGIN)[:, None]
            one = left.sum(axis=1) == 1
            for ball, c in zip(level[one].tolist(), np.argmax(left[one], axis=1).tolist()):
                whole.append((ball, c))
                cluster[self.low[ball] : self.high[ball]] = c
            level, left = level[~one], left[~one]
            leaf = 2 * level + 1 >= n
            for ball, own in zip(level[leaf].tolist(), left[leaf]):
                a, b = self.low[ball], self.high[ball]
                near = np.flatnonzero(own)
                cluster[a:b] = near[squared(self.x[a:b], centroids[near]).argmin(axis=1)]  # the first of equal ones: the smaller number
                compared.append(np.arange(a, b))
            level, left = level[~leaf], left[~leaf]
            level, left = np.concatenate((2 * level + 1, 2 * level + 2)), np.concatenate((left, left))
        return cluster, whole, np.concatenate(compared) if compared else np.zeros(0, np.int64)

    def partial(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and integer sum of the vectors of each centroid."""
        cluster, whole, compared = self.assign(centroids)
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for ball, c in whole:
            count[c] += self.high[ball] - self.low[ball]
            sums[c] += self.sums[ball]
        np.add.at(count, cluster[compared], 1)
        np.add.at(sums, cluster[compared], self.x[compared])
        return count, sums


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, rows of x by rows of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < _EXACT:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1)


_TREES = "ids array<bigint>, x binary, low binary, high binary, centre binary, radius binary, sums binary"


def ball_trees(vectors: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """One row for each tree: BLOCK vectors at most, as they lie in their partition; vectors that are not kept are in none."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dimension) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))

    def built(ids: list[pa.Array], own: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = Tree.of(np.concatenate(own))
        cols = [pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))]
        cols += [pa.array([a.tobytes()], pa.binary()) for a in (tree.x, tree.low, tree.high, tree.centre, tree.radius, tree.sums)]
        return pa.RecordBatch.from_arrays(cols, ["ids", "x", "low", "high", "centre", "radius", "sums"])

    def run(batches):
        ids, own, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(start, BLOCK // 4)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)
                ids.append(part.column("id"))
                own.append(x)
                held += len(x)
                if held > BLOCK - BLOCK // 4:
                    yield built(ids, own)
                    ids, own, held = [], [], 0
        if held:
            yield built(ids, own)

    return rows.mapInArrow(run, _TREES)


def _trees(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = {c: batch.column(c)[i].as_buffer() for c in ("x", "low", "high", "centre", "radius", "sums")}
            whole = {c: np.frombuffer(got[c], np.int64) for c in ("x", "low", "high", "sums")}
            yield batch.column("ids")[i].values, Tree(whole["x"].reshape(-1, dimension), whole["low"], whole["high"], np.frombuffer(got["centre"]).reshape(-1, dimension), np.frombuffer(got["radius"]), whole["sums"].reshape(-1, dimension))


def _first(trees: DataFrame, k: int, dimension: int) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of "1:" and their id, in that order; ties by components, null ids last."""

    def run(batches):
        for ids, tree in _trees(batches, dimension):
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(tree.x), pa.list_(pa.int64()))], ["id", "x"])

    named = trees.mapInArrow(run, "id bigint, x array<bigint>").withColumn("key", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    rows = named.orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), dimension)


def _moved(trees: DataFrame, centroids: np.ndarray, dimension: int) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean of their vectors; empty ones stay."""

    def run(batches):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for held, (_, tree) in enumerate(_trees(batches, dimension), 1):
            one, added = tree.partial(centroids)
            count += one
            sums += added
            if held % 1024 == 0:  # sums of so many blocks fit a long
                yield told(count, sums)
                count, sums = np.zeros_like(count), np.zeros_like(sums)
        yield told(count, sums)

    def told(count, sums):
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids))), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], ["c", "n", "s"])

    partial = trees.mapInArrow(run, "c bigint, n bigint, s array<bigint>").where("n > 0")
    wide = "decimal(38,0)"
    total = partial.select("c", "n", F.posexplode("s").alias("d", "s")).groupBy("c", "d").agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("s").cast(wide)).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k x dimension rows
        out[r.c, r.d] = int(r.s) // int(r.n)
    return out


def clustered(vectors: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """Rows (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector.

    Kept are vectors of that many components, none null or not finite, as
    integers floor(scale * x); components beyond LARGEST are held there, so that
    a squared distance fits a long. The first centroids are the k vectors of the
    smallest hashes of their id (fewer, if fewer are kept); rounds times, all
    vectors go to the nearest centroid (ties: the smaller number) and centroids
    move to the floor of the mean, empty ones not at all. distance is squared,
    to the final centroid. Rows that repeat an id or a vector are reported each,
    null ids too; other columns are not read; without kept vectors there are no
    rows.
    """
    trees = written(ball_trees(vectors, id_col, vector_col, dimension, scale), "trees")
    centroids = _first(trees, k, dimension)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(trees, centroids, dimension)

    def run(batches):
        for ids, tree in _trees(batches, dimension):
            cluster = tree.assign(centroids)[0]
            distance = ((tree.x - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    own = written(trees.mapInArrow(run, "id bigint, cluster int, distance bigint"), "assigned")
    forget(trees)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in own.groupBy("cluster").agg(wide.alias("s")).collect()}  # k rows
    names = own.sparkSession.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, row))) for c, row in enumerate(centroids.tolist())], "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    facts = F.broadcast(names.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid"))  # k rows
    return own.join(facts, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
