"""Space-filling samplers: sample(n, space, pool, known) gives n rows of a pool, or n points of a space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpool.functions.frames import anti, block, by_key, checkpointed, few, seeded
from siftpool.operators.design import lhs_design, random_design, sobol_design
from siftpool.operators.distance import NEAR, Distance, Geometry, Gower, distance
from siftpool.operators.nearest import tasks
from siftpool.operators.profiles import Computed, GowerProfiles, Stored, lists, matrix, parts, with_sums
from siftpool.space import Space

CHECKPOINT = 8  # steps of a loop between checkpoints
CELLS = 2048  # boxes of candidates, about, and candidates that are compared with all rows


class SamplerError(ValueError):
    pass


class Sampler:
    key, label, deterministic, needs_pool, takes_pool = "", "", True, False, True

    def sample(self, n: int, space: Space, pool: DataFrame | None = None, known: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
        """n rows with the space's columns; a pool of n rows or fewer comes back whole."""
        spark = spark or (pool.sparkSession if pool is not None else SparkSession.active())
        if pool is not None:
            pool = space.project(pool)
            if pool.limit(n + 1).count() <= n:
                return pool
            if not self.takes_pool:
                raise SamplerError(f"sampler '{self.key}' does not support 'pool'")
        elif self.needs_pool:
            raise SamplerError(f"sampler '{self.key}' currently requires a pool")
        return self._sample(n, space, pool, None if known is None else space.project(known), spark)

    def _sample(self, n, space, pool, known, spark) -> DataFrame:
        raise NotImplementedError


class Uniform(Sampler):
    """A sample without replacement by a seeded hash, or independent points."""

    key, label = "uniform", "Uniform"

    def __init__(self, seed: int = 1):
        self.seed = seed

    def _sample(self, n, space, pool, known, spark):
        if pool is None:
            return random_design(spark, space, n, self.seed)
        return pool.orderBy(seeded(self.seed, space.ids), *by_key(space.ids)).limit(n)


class Lhs(Sampler):
    key, label, deterministic, takes_pool = "lhs", "Latin hypercube", False, False

    def __init__(self, seed: int = 1):
        self.seed = seed

    def _sample(self, n, space, pool, known, spark):
        return lhs_design(spark, space, n, self.seed)


class Sobol(Sampler):
    key, label, takes_pool = "sobol", "Sobol sequence", False

    def _sample(self, n, space, pool, known, spark):
        return sobol_design(spark, space, n)


def _fitted(dist: Distance, space: Space, pool: DataFrame, known: DataFrame | None) -> Distance:
    return dist.fit(pool if known is None else pool.unionByName(known), space)


def farthest_first(pool: DataFrame, space: Space, dist: Distance, n: int, known: DataFrame | None = None) -> list[dict]:
    """Greedy maximin: the n rows, one after another, farthest from what is known or picked; the first without known rows is nearest to all.

    Each pick is one job over a column with the distance to the nearest picked
    row, which the next pick only lowers. Scores are rounded to nine digits,
    ties go by ids.
    """
    ids, picked = space.ids, []
    far = F.desc(F.round("near", 9))
    if known is not None and not known.isEmpty():
        rows = dist.set_references(known).nearest(pool, "near")
    else:
        if isinstance(dist, Geometry):  # the sum of squared distances to all is least next to the mean
            embed = dist.embedding()
            mean = pool.agg(*(F.avg(e).alias(f"m{k}") for k, e in enumerate(embed))).first()
            total = sum(((e - F.lit(mean[k] or 0.0)) * (e - F.lit(mean[k] or 0.0)) for k, e in enumerate(embed[1:], 1)), (embed[0] - F.lit(mean[0] or 0.0)) * (embed[0] - F.lit(mean[0] or 0.0)))
            rows = pool.withColumn("total", total)
        else:
            squares = lambda refs: F.aggregate(F.transform(refs, lambda r: F.pow(dist.between(r), 2)), F.lit(0.0), lambda a, x: a + x)
            rows = dist.set_references(pool).fold(pool, "total", squares, lambda a, b: a + b)
        first = rows.orderBy(F.round("total", 9), *by_key(ids)).limit(1).select(*ids).collect()
        if not first:
            return picked
        picked.append(first[0].asDict())
        rows = pool.withColumn("near", dist.to(picked[0]))
    while len(picked) < n:
        row = anti_literals(rows, ids, picked).orderBy(far, *by_key(ids)).limit(1).select(*ids).collect()
        if not row:
            break
        picked.append(row[0].asDict())
        rows = rows.withColumn("near", F.least("near", dist.to(picked[-1])))
        if len(picked) % CHECKPOINT == 0:
            rows = checkpointed(rows)
    return picked


def anti_literals(rows: DataFrame, ids: list[str], picked: list[dict]) -> DataFrame:
    """rows without those picked."""
    for p in picked:
        hit = F.lit(True)
        for c in ids:
            hit = hit & F.col(c).eqNullSafe(F.lit(p[c]))
        rows = rows.where(~hit)
    return rows


def picked_rows(spark: SparkSession, picked: list[dict], space: Space) -> DataFrame:
    return space.cast(spark.createDataFrame([tuple(p[c] for c in space.ids) for p in picked], space.struct_type()))


class GSx(Sampler):
    """Greedy sampling in input space."""

    key, label, deterministic, needs_pool = "gsx", "Greedy sampling in input space", False, True

    def __init__(self, dist: Distance | str = "standardize"):
        self.distance = distance(dist) if isinstance(dist, str) else dist

    def _sample(self, n, space, pool, known, spark):
        return picked_rows(spark, farthest_first(pool, space, _fitted(self.distance, space, pool, known), n, known), space)


def representatives(pool: DataFrame, space: Space, dist: Geometry, centres: list[list[float]]) -> list[dict]:
    """For each centre, in order, the nearest pool row not yet taken; ties by ids."""
    picked: list[dict] = []
    for c in centres:
        d = sum(((e - F.lit(float(x))) * (e - F.lit(float(x))) for e, x in zip(dist.embedding(), c)), F.lit(0.0))
        row = anti_literals(pool, space.ids, picked).orderBy(F.round(d, 9), *by_key(space.ids)).limit(1).collect()
        picked += [r.asDict() for r in row]
    return picked


def _least(values: list[Column]) -> Column:
    """The number of the least value (to twelve digits), the first of equal ones."""
    return F.array_min(F.array(*(F.struct(F.round(v, 12).alias("v"), F.lit(k).alias("k")) for k, v in enumerate(values))))["k"]


class KMeans(Sampler):
    """Centres of MLlib's k-means over pool and known rows, each represented by the nearest pool row."""

    key, label, deterministic, needs_pool = "kmeans", "k-means", False, True

    def __init__(self, dist: Distance | str = "affine", starts: int = 10, seed: int = 1):
        self.distance, self.starts, self.seed = distance(dist) if isinstance(dist, str) else dist, starts, seed

    def _centres(self, n: int, rows: DataFrame) -> list[list[float]]:
        if n == 1:
            embed = self.distance.embedding()
            return [[x or 0.0 for x in rows.agg(*(F.avg(e) for e in embed)).first()]]
        from pyspark.ml.clustering import KMeans as Fit
        from pyspark.ml.functions import array_to_vector

        data = rows.select(array_to_vector(F.array(*self.distance.embedding())).alias("features")).persist()
        fits = [Fit(k=n, seed=self.seed + s, maxIter=100).fit(data) for s in range(self.starts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        data.unpersist()
        if len(best.clusterCenters()) < n:
            raise SamplerError("more centres than distinct points")
        return sorted(list(map(float, c)) for c in best.clusterCenters())

    def _sample(self, n, space, pool, known, spark):
        if not isinstance(self.distance, Geometry):
            raise SamplerError("k-means needs a distance with an embedding")
        _fitted(self.distance, space, pool, known)
        rows = pool if known is None else pool.unionByName(known)
        return picked_rows(spark, representatives(pool, space, self.distance, self._centres(n, rows)), space)


class RelationalKMeans(KMeans):
    """Lloyd's steps on distances to clusters.

    For a distance with an embedding, the mean squared distance to a cluster
    less half its mean inner one is the squared distance to the cluster's mean,
    so a step is one aggregation and no matrix of distances is made. With Gower's,
    a step reads the clusters' profiles for all starts at once (GowerProfiles).
    Up to NEAR rows, and under further distances, rows are compared with each
    other in blocks instead, to the same sums. A step is three jobs: what the
    labels count, the sums of inner distances, and the labels that follow. Emptied clusters take the point
    farthest from its cluster.
    """

    key, label = "relational_kmeans", "Relational k-means"

    def __init__(self, dist: Distance | str = "affine", starts: int = 10, steps: int = 100, seed: int = 1):
        super().__init__(dist, starts, seed)
        self.steps = steps

    def _sample(self, n, space, pool, known, spark):
        if isinstance(self.distance, Geometry):
            return super()._sample(n, space, pool, known, spark)
        return picked_rows(spark, self._by_distances(n, space, pool, known), space)

    def _by_distances(self, n: int, space: Space, pool: DataFrame, known: DataFrame | None) -> list[dict]:
        d, ids, starts = _fitted(self.distance, space, pool, known), space.ids, self.starts if n > 1 else 1
        rows = pool.withColumn("own__", F.lit(True))
        if known is not None:
            rows = rows.unionByName(known.withColumn("own__", F.lit(False)))
        rows = checkpointed(rows.withColumn("row__", F.monotonically_increasing_id()))
        first = []
        for s in range(starts):
            seeds = rows.select(ids).distinct().orderBy(F.xxhash64(*ids, F.lit(self.seed + s)), *by_key(ids)).limit(n).collect()
            if len(seeds) < n:
                raise SamplerError("more centres than distinct points")
            first.append(_least([F.pow(d.to(r.asDict()), 2) for r in seeds]))
        source = self._compared(rows, d, n, starts)
        told = checkpointed(source.rows.withColumns({"labels__": F.array(*(x.cast("int") for x in first)), "moved__": F.lit(0)}))
        for step in range(self.steps + 1):
            state, filled, moved = source.counted(told, n, starts)
            if step and any((s, k) not in filled for s in range(starts) for k in range(n)):
                again = checkpointed(_moving(frame, of, size, inner, n, starts, True))
                for s in range(starts):
                    if any((s, k) not in filled for k in range(n)):
                        again = self._repaired(again, apart[s], s, n)
                differ = F.aggregate(F.zip_with("new__", "labels__", lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
                told = checkpointed(again.withColumn("moved__", differ).drop("labels__", "sums__").withColumnRenamed("new__", "labels__"))
                state, filled, moved = source.counted(told, n, starts)
            if step and not moved:
                break
            frame, of = source.summing(told, state, n, starts)
            size, inner = _held(frame, of, n, starts)
            held = {divmod(c, n): (int(size[c]), float(inner[c])) for c in range(n * starts) if size[c]}
            apart = [[self._apart(held.get((s, k)), s * n + k) for k in range(n)] for s in range(starts)]
            if step == self.steps:
                break
            told = checkpointed(_moving(frame, of, size, inner, n, starts))
        told = checkpointed(with_sums(frame, of))
        cost = [sum(inner / (2 * size) for (t, _), (size, inner) in held.items() if t == s) for s in range(starts)]
        best = min(range(starts), key=lambda s: (round(cost[s], 12), s))
        picked: list[dict] = []
        for k in range(n):
            row = anti_literals(told.where("own__"), ids, picked).orderBy(F.round(apart[best][k], 9), *by_key(ids)).limit(1).select(*ids).collect()
            picked += [r.asDict() for r in row]
        return picked

    def _compared(self, rows: DataFrame, d: Distance, n: int, starts: int) -> GowerProfiles | _Block | _Blocks:
        if few(rows, NEAR):
            return _Block(rows, d)
        profiles = GowerProfiles(rows, d) if isinstance(d, Gower) else None
        return profiles if profiles is not None and profiles.fits(n * starts) else _Blocks(rows, d)

    @staticmethod
    def _sums(told: DataFrame, d: Distance, n: int, starts: int) -> DataFrame:
        """told with the sum of squared distances to each cluster of each start, by comparing its rows with each other in blocks."""
        labels = [f"label{s}__" for s in range(starts)]
        d.references, d._carried = told.select(*d.space.ids, *(F.col("labels__")[s].alias(c) for s, c in enumerate(labels))), labels

        def kernel(apart: np.ndarray, _, y: np.ndarray) -> np.ndarray:
            member = (y[:, :, None] == np.arange(n)).reshape(len(y), starts * n)
            return apart**2 @ member

        names = [f"sum{c}" for c in range(starts * n)]
        out = d.over_references(told, "told__", kernel, np.add, names)
        return out.select(*told.columns, F.array(*(F.col(f"told__.{c}") for c in names)).alias("sums__"))

    @staticmethod
    def _apart(held: tuple[int, float] | None, at: int) -> Column:
        """Squared distance of a row to a cluster of that size and sum of inner squared distances."""
        return F.lit(float("inf")) if held is None else F.col("sums__")[at] / F.lit(float(held[0])) - F.lit(held[1] / (2 * held[0] ** 2))

    @staticmethod
    def _repaired(moved: DataFrame, apart: list[Column], s: int, n: int) -> DataFrame:
        label = F.col("new__")[s]
        size = {r.k: r["count"] for r in moved.groupBy(label.alias("k")).count().collect()}
        lost = [k for k in range(n) if k not in size]
        if not lost:
            return moved
        far = F.element_at(F.array(*apart), label + 1)
        # each cluster keeps one row, so at most n of the farthest rows can't move
        worst = moved.select("row__", label.alias("k"), far.alias("far")).orderBy(F.desc(F.round("far", 12)), "row__").limit(2 * n).collect()
        to = {}
        for k in lost:
            r = next((r for r in worst if r["row__"] not in to and size[r.k] > 1), None)
            if r is None:
                raise SamplerError("an emptied cluster finds no row")
            size[r.k] -= 1
            to[r["row__"]] = k
        new = label
        for row, k in to.items():
            new = F.when(F.col("row__") == row, F.lit(k)).otherwise(new)
        return checkpointed(moved.withColumn("new__", F.transform("new__", lambda x, i: F.when(i == s, new).otherwise(x))))

    def _centres(self, n, rows):
        if n == 1:
            return super()._centres(n, rows)
        data = checkpointed(rows.select(F.array(*self.distance.embedding()).alias("x")))
        points, centres, cost = checkpointed(data.distinct()), [], [None] * self.starts
        for s in range(self.starts):
            start = points.orderBy(F.xxhash64("x", F.lit(self.seed + s)), "x").limit(n).collect()
            if len(start) < n:
                raise SamplerError("more centres than distinct points")
            centres.append([[float(v) for v in r.x] for r in start])
        moving = list(range(self.starts))
        for _ in range(self.steps):
            told, left = _lloyd(data, {s: centres[s] for s in moving}), []
            for s in moving:
                new, lost, total = list(centres[s]), [k for k in range(n) if (s, k) not in told], sum(v[2] for (t, _), v in told.items() if t == s)
                for k in range(n):
                    if k not in lost:
                        size, sums, _ = told[s, k]
                        new[k] = [v / size for v in sums]
                if lost:
                    far = F.array_min(F.array(*(F.round(_squared(c), 12) for c in centres[s])))
                    for k, r in zip(lost, data.withColumn("far", far).orderBy(F.desc("far"), "x").limit(len(lost)).collect()):
                        new[k] = [float(v) for v in r.x]
                if np.allclose(new, centres[s], atol=1e-9) and not lost:
                    cost[s] = total if cost[s] is None else cost[s]
                    continue
                centres[s], cost[s] = new, total
                left.append(s)
            moving = left
            if not moving:
                break
        best = 0
        for s in range(1, self.starts):
            if (cost[s] or 0.0) < (cost[best] or 0.0) - 1e-12:
                best = s
        return sorted(centres[best])


class _Block:
    """Rows that are few enough to be sent to all tasks, compared with each other."""

    def __init__(self, rows: DataFrame, d: Distance):
        self.ids, self.apart, self.width = d.space.ids, d.kernel(), len(d.stored())
        self.rows = checkpointed(rows.withColumns({f"at{k}__": c.cast("double") for k, c in enumerate(d.stored())}))

    def counted(self, told: DataFrame, n: int, starts: int) -> tuple[tuple[np.ndarray, np.ndarray], set[tuple[int, int]], int]:
        """All rows and their labels, which clusters of which starts have rows, and how many labels moved__ tells; one job."""
        got = block(told, [*(F.col(f"at{k}__") for k in range(self.width)), *(F.col("labels__")[s] for s in range(starts)), F.col("moved__")], [*by_key(self.ids), F.col("row__")])
        labels = got[:, self.width : -1].astype(int)
        return (got[:, : self.width], labels), {(s, int(k)) for s in range(starts) for k in np.unique(labels[:, s])}, int(got[:, -1].sum())

    def summing(self, told: DataFrame, state: tuple[np.ndarray, np.ndarray], n: int, starts: int) -> tuple[DataFrame, Computed]:
        sent, apart, width = told.sparkSession.sparkContext.broadcast(state), self.apart, self.width

        def of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            refs, labels = sent.value
            member = (labels[:, :, None] == np.arange(n)).reshape(len(refs), starts * n).astype(float)
            x = np.column_stack([group.column(f"at{k}__").to_numpy().astype(float) for k in range(width)])
            step = max(1, (1 << 21) // max(1, len(refs)))
            return matrix(group, "labels__", starts), np.concatenate([apart(x[i : i + step], refs) ** 2 @ member for i in range(0, len(x), step)])

        return told, Computed(of, False)


class _Blocks:
    """Rows compared with each other in blocks."""

    def __init__(self, rows: DataFrame, d: Distance):
        self.rows, self.distance = rows, d

    def counted(self, told: DataFrame, n: int, starts: int) -> tuple[None, set[tuple[int, int]], int]:
        got = told.select(F.posexplode("labels__").alias("s", "k"), "moved__").groupBy("s", "k").agg(F.sum("moved__").alias("moved")).collect()  # starts x n at most
        return None, {(r.s, r.k) for r in got}, sum(r.moved for r in got)

    def summing(self, told: DataFrame, state: None, n: int, starts: int) -> tuple[DataFrame, Stored]:
        return checkpointed(RelationalKMeans._sums(told, self.distance, n, starts)), Stored(n, starts)


def _held(frame: DataFrame, of: Stored | Computed, n: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster of each start its size and the sum of its squared inner distances."""

    def run(batches):
        total = np.zeros((2, starts * n))
        for group in parts(batches, of.whole):
            labels, sums = of(group)
            at = labels + np.arange(starts) * n
            total[0] += np.bincount(at.reshape(-1), minlength=starts * n)
            total[1] += np.bincount(at.reshape(-1), np.take_along_axis(sums, at, axis=1).reshape(-1), starts * n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["slot", "v"])

    got = frame.mapInArrow(run, "slot bigint, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(2 * starts * n)
    out[got["slot"]] = got["v"]
    return out[: starts * n], out[starts * n :]


def _moving(frame: DataFrame, of: Stored | Computed, size: np.ndarray, inner: np.ndarray, n: int, starts: int, both: bool = False) -> DataFrame:
    """frame with each row's nearest clusters as labels__, and in moved__ how many are others than before; with both, they are new__ beside labels__ and sums__."""
    there, half = size > 0, inner / (2 * np.maximum(size, 1) ** 2)
    kept = [f for f in frame.schema.fields if f.name not in ("labels__", "moved__", "sums__")]
    ints = T.ArrayType(T.IntegerType())
    more = [("labels__", ints), ("sums__", T.ArrayType(T.DoubleType())), ("new__", ints)] if both else [("labels__", ints), ("moved__", T.IntegerType())]

    def run(batches):
        for group in parts(batches, of.whole):
            labels, sums = of(group)
            apart = np.where(there, np.round(sums / np.maximum(size, 1) - half, 12), np.inf)
            new = apart.reshape(len(labels), starts, n).argmin(axis=2).astype(np.int32)
            told = [lists(labels.astype(np.int32)), lists(sums), lists(new)] if both else [lists(new), pa.array((new != labels).sum(axis=1).astype(np.int32))]
            yield from pa.Table.from_arrays([*(group.column(f.name) for f in kept), *told], [*(f.name for f in kept), *(name for name, _ in more)]).to_batches()

    return frame.mapInArrow(run, T.StructType([*kept, *(T.StructField(*m) for m in more)]))


def _squared(c: list[float]) -> Column:
    """Squared distance of an array x to a centre."""
    return F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)


def _lloyd(data: DataFrame, centres: dict[int, list[list[float]]]) -> dict[tuple[int, int], tuple[int, list[float], float]]:
    """For each start and each of its centres that is the nearest of some rows of data (x array): their number, their sums and their squared distances' sum; one job for all starts."""
    at = {s: np.array(c, float) for s, c in centres.items()}
    dim = len(next(iter(at.values()))[0])

    def run(batches):
        told = {s: np.zeros((len(c), dim + 2)) for s, c in at.items()}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            for s, c in at.items():
                apart = np.zeros((len(x), len(c)))
                for j in range(dim):
                    apart += (x[:, j, None] - c[None, :, j]) ** 2
                apart = np.round(apart, 12)
                near = apart.argmin(axis=1)
                told[s] += np.column_stack([np.bincount(near, w, len(c)) for w in (np.ones(len(x)), *x.T, apart[np.arange(len(x)), near])])
        got = [(s, k, v.tolist()) for s, t in told.items() for k, v in enumerate(t) if v[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int32()), pa.array([r[1] for r in got], pa.int32()), pa.array([r[2] for r in got], pa.list_(pa.float64()))], ["s", "k", "v"])

    parts = data.mapInArrow(run, "s int, k int, v array<double>").groupBy("s", "k").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(dim + 2)))
    return {(r.s, r.k): (int(r.v0), list(r[3:-1]), r[-1]) for r in parts.collect()}  # starts x centres at most


class KMedoids(Sampler):
    """Partitioning around medoids: greedy building, then the best exchange while one lowers the cost; known rows are medoids that stay.

    The cost of a candidate is a sum over all rows. Up to NEAR rows, a step compares
    the pool with itself. Beyond, boxes of candidates meet all rows first: those
    whose least possible cost is above the largest possible one of another are
    left out, the others are cut smaller, and what remains is compared with all
    rows in blocks of bounded size; no matrix is kept. Rows carry
    their distances to the nearest and the second nearest medoid and which the
    nearest is: one pass then gives the cost of every exchange of a medoid and a
    candidate.
    """

    key, label, deterministic, needs_pool = "kmedoids", "k-medoids (PAM)", True, True

    def __init__(self, dist: Distance | str = "gower"):
        self.distance = distance(dist) if isinstance(dist, str) else dist

    def _summed(self, cands: DataFrame, rows: DataFrame, carry: list[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
        """cands with a struct sums: kernel(distances of candidates and rows, the rows' carried columns), added up over all rows."""
        d = self.distance
        d.references, d._carried = rows.select(*d.space.ids, *carry), carry
        plain = (lambda apart, _, y: kernel(np.sqrt(apart), y)) if d.geometric else (lambda apart, _, y: kernel(apart, y))
        return d.over_references(cands, "sums", plain, np.add, names)

    def _hopeful(self, cands: DataFrame, rows: DataFrame, carry: list[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> DataFrame:
        """The candidates that may have the least of one of kernel()'s n sums, none of which falls as a distance grows."""
        if few(rows, NEAR):
            return cands
        d, bounds, level = self.distance, self.distance.between_boxes(), 0
        parts, ids = d.parts(), cands.columns
        width = len(parts)
        at = [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in d.stored()]
        own = rows.select(*(c.alias(f"at{k}__") for k, c in enumerate(at)), *(F.col(c).cast("double").alias(c) for c in carry))
        own = checkpointed(own.repartition(tasks(rows)))
        left = checkpointed(cands.withColumns({f"at{k}__": c for k, c in enumerate(at)}))
        span = left.agg(*(f(f"at{k}__").alias(f"{n}{k}") for k in range(len(at)) for n, f in (("lo", F.min), ("hi", F.max)))).first()

        def cell(level: int) -> Column:
            out = []
            for k, s in enumerate(parts):
                v, wide = F.col(f"at{k}__"), (span[f"hi{k}"] or 0.0) - (span[f"lo{k}"] or 0.0)
                if s is None:
                    out.append(v)
                elif wide > 0:
                    out.append(F.floor((v - F.lit(span[f"lo{k}"])) / F.lit(wide / 2.0**level)).cast("double"))
                else:
                    out.append(v * 0.0)
            return F.array(*(F.coalesce(c, F.lit(-1e300)) for c in out))

        while left.limit(CELLS + 1).count() > CELLS and level < 40:
            sizes = left.agg(*(F.approx_count_distinct(cell(level + i)).alias(str(i)) for i in range(1, 7))).first()
            if sizes["1"] > 16 * CELLS:  # boxes of many columns or levels tell too little
                break
            level += max([1, *(i for i in range(1, 7) if sizes[str(i)] <= CELLS)])
            boxes = left.groupBy(cell(level).alias("cell__")).agg(*(f(f"at{k}__").cast("double").alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(len(at)))).toPandas()  # 16 CELLS, about, at most
            ends = boxes.drop(columns="cell__").to_numpy(float).reshape(len(boxes), 2, len(at))
            sent = rows.sparkSession.sparkContext.broadcast(ends)

            def run(batches, sent=sent):
                ends = sent.value
                total = np.zeros((len(ends), 2, n))
                for batch in batches:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                    for a in range(0, len(x), 2048):
                        y = x[a : a + 2048]
                        for b in range(0, len(ends), 256):
                            for side, apart in enumerate(bounds(ends[b : b + 256, 0], ends[b : b + 256, 1], y[:, :width])):
                                total[b : b + 256, side] += kernel(apart, y[:, width:]).reshape(-1, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["slot", "v"])

            got = own.mapInArrow(run, "slot bigint, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
            total = np.zeros(ends.shape[0] * 2 * n)
            total[got["slot"]] = got["v"]
            low, high = total.reshape(-1, 2, n)[:, 0], total.reshape(-1, 2, n)[:, 1].min(axis=0)
            kept = (low <= high + 1e-6 + 1e-9 * np.abs(high)).any(axis=1)
            told = rows.sparkSession.createDataFrame([(list(map(float, c)),) for c in boxes["cell__"][kept]], "cell__ array<double>")
            left = checkpointed(left.withColumn("cell__", cell(level)).join(F.broadcast(told), "cell__").drop("cell__"))
        return left.select(*ids)

    def _costs(self, cands: DataFrame, rows: DataFrame) -> DataFrame:
        """cands with the cost that each would bring as a further medoid: rows carry their distance to the medoids there are in base. Those that can't be the least may be left out."""

        def kernel(d: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.fmin(d, y[None, :, 0]).sum(axis=1)

        return self._summed(self._hopeful(cands, rows, ["base"], kernel, 1), rows, ["base"], kernel, ["cost"]).withColumn("cost", F.col("sums.cost")).drop("sums")

    def _exchanges(self, cands: DataFrame, rows: DataFrame, n: int) -> DataFrame:
        """cands with the costs of exchanging each of n medoids for them: rows carry first, second and owner. Those that can't be the least may be left out."""

        def kernel(d: np.ndarray, y: np.ndarray) -> np.ndarray:
            one = np.fmin(d, y[None, :, 0])
            more = np.fmin(d, y[None, :, 1]) - one  # if the nearest medoid goes
            return np.column_stack([one.sum(axis=1), *(more[:, y[:, 2] == k].sum(axis=1) for k in range(n))])

        def each(d: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = kernel(d, y)
            return out[:, :1] + out[:, 1:]

        carry = ["first", "second", "owner"]
        told = self._summed(self._hopeful(cands, rows, carry, each, n), rows, carry, kernel, ["all", *(f"x{k}" for k in range(n))])
        return told.select(*cands.columns, *((F.col("sums.all") + F.col(f"sums.x{k}")).alias(f"cost{k}") for k in range(n)))

    def _near(self, rows: DataFrame, picked: list[dict]) -> DataFrame:
        """rows with their nearest medoid (owner; -1 is a known one), the distance to it and to the second nearest."""
        every = F.array(F.struct(F.col("fixed").alias("d"), F.lit(-1).alias("k")), *(F.struct(self.distance.to(m).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(picked)))
        order = F.array_sort(F.filter(every, lambda x: x["d"].isNotNull()))
        return rows.withColumns({"first": F.get(order, F.lit(0))["d"], "second": F.get(order, F.lit(1))["d"], "owner": F.get(order, F.lit(0))["k"].cast("double")})

    def _sample(self, n, space, pool, known, spark):
        _fitted(self.distance, space, pool, known)
        rows, none = pool.withColumn("fixed", F.lit(None).cast("double")), known is None or known.isEmpty()
        if not none:
            self.distance.set_references(known.distinct())
            rows = self.distance.nearest(pool.unionByName(known), "fixed")
        rows, pool = checkpointed(rows), checkpointed(pool)
        ids, picked = space.ids, []
        while len(picked) < n:
            base = rows.withColumn("base", F.least("fixed", *(self.distance.to(m) for m in picked)) if picked else F.col("fixed"))
            costs = self._costs(anti_literals(pool, ids, picked), base)
            picked.append(costs.orderBy(F.round("cost", 9), *by_key(ids)).limit(1).select(*ids).first().asDict())
        while True:
            near = checkpointed(self._near(rows, picked))
            cost = near.agg(F.sum("first")).first()[0]
            told = self._exchanges(anti_literals(pool, ids, picked), near, n)
            least = told.agg(*(F.min(F.struct(F.round(f"cost{k}", 9).alias("rounded"), *ids, F.col(f"cost{k}").alias("cost"))).alias(f"best{k}") for k in range(n))).first()
            best = None
            for k in range(n):
                row = least[f"best{k}"]
                if row is not None and (best is None or row["cost"] < best[0] - 1e-9):
                    best = (row["cost"], k, {c: row[c] for c in ids})
            if best is None or best[0] >= cost - 1e-9:
                return picked_rows(spark, picked, space)
            picked[best[1]] = best[2]


def stage_sizes(pool_size: int | None, n: int, stages: int) -> list[int]:
    """Sizes of a chain's stages: a rounded geometric sequence from the pool's size down to n, or doublings of n without a pool."""
    if pool_size is None:
        return [n * 2 ** (stages - 1 - k) for k in range(stages)]
    ratio = (n / pool_size) ** (1 / stages)
    return [n if k == stages else max(n, min(pool_size, round(pool_size * ratio**k))) for k in range(1, stages + 1)]


class Chain(Sampler):
    """Samplers one after another, each from what the one before chose."""

    key, label = "chain", "Chain of samplers"

    def __init__(self, samplers: list[Sampler], sizes: Callable[[int | None, int], list[int]] | None = None):
        self.samplers = samplers
        self.sizes = sizes or (lambda size, n: stage_sizes(size, n, len(samplers)))
        self.deterministic = all(s.deterministic for s in samplers)

    def _sample(self, n, space, pool, known, spark):
        sizes = self.sizes(None if pool is None else pool.count(), n)
        if len(sizes) != len(self.samplers) or sizes[-1] != n or any(a < b for a, b in zip(sizes, sizes[1:])):
            raise SamplerError("stage sizes must not grow, and end at n")
        for sampler, size in zip(self.samplers, sizes):
            pool = sampler.sample(size, space, pool, known, spark)
        return pool


class Conditional(Sampler):
    """One sampler with a pool, another without."""

    key, label = "conditional", "By whether there is a pool"

    def __init__(self, with_pool: Sampler, without_pool: Sampler):
        self.with_pool, self.without_pool = with_pool, without_pool
        self.deterministic = with_pool.deterministic and without_pool.deterministic

    def _sample(self, n, space, pool, known, spark):
        return (self.without_pool if pool is None else self.with_pool).sample(n, space, pool, known, spark)


SAMPLERS: dict[str, Callable[..., Sampler]] = {c.key: c for c in (Uniform, Lhs, Sobol, GSx, KMeans, RelationalKMeans, KMedoids, Chain, Conditional)}


def sampler(key: str, **args) -> Sampler:
    if key not in SAMPLERS:
        raise SamplerError(f"no sampler '{key}'; there are {', '.join(sorted(SAMPLERS))}")
    return SAMPLERS[key](**args)


def unseen(pool: DataFrame, known: DataFrame, space: Space) -> DataFrame:
    """Pool rows whose features are not known."""
    return anti(pool, known, space.ids)
