"""Surrogates: fit(archive, space, target), then predict(rows) adds mean and se."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import by_key, checkpointed, few
from siftpool.operators.distance import NEAR, Distance, Standardize, distance
from siftpool.operators.nearest import Euclidean, nearest
from siftpool.space import Space


class SurrogateError(ValueError):
    pass


class Surrogate:
    has_se = True

    def fit(self, archive: DataFrame, space: Space, target: str) -> Surrogate:
        raise NotImplementedError

    def fit_each(self, rows: DataFrame, key: str, space: Space, target: str) -> Callable[[int], Surrogate] | None:
        """Models of all groups of rows by key, fitted in one aggregation, as a function of the key; None if the kind can't."""
        return None

    def predict(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def form(self) -> tuple[np.ndarray, list[str]] | None:
        """The mean as intercept and weights of those columns, if it is linear."""
        return None


class NoSurrogate(Surrogate):
    """Holds the archive's place where no model is wanted; predicting is an error."""

    def fit(self, archive, space, target):
        return self

    def predict(self, rows):
        raise SurrogateError("this surrogate can't predict")


class Constant(Surrogate):
    """Mean and standard deviation of the target."""

    def fit(self, archive, space, target):
        return self._of(archive.agg(*self._sums(target)).first())

    def fit_each(self, rows, key, space, target):
        told = {r[2]: r for r in rows.groupBy(key).agg(*self._sums(target)).select("mean", "se", key).collect()}
        return lambda k: Constant()._of(told.get(k, (None, None)))

    def _sums(self, target: str) -> list[Column]:
        return [F.avg(target).cast("double").alias("mean"), F.stddev_samp(target).cast("double").alias("se")]

    def _of(self, row) -> Constant:
        self.mean, self.se = row[0], row[1] or 0.0
        return self

    def form(self):
        return None if self.mean is None else (np.array([self.mean]), [])

    def predict(self, rows):
        return rows.withColumn("mean", F.lit(self.mean).cast("double")).withColumn("se", F.lit(self.se))


class Linear(Surrogate):
    """Least squares on the numeric columns; the normal equations are one aggregation, se is the residuals' deviation."""

    def fit(self, archive, space, target):
        known, sums = self._sums(archive, space, target)
        return self._of(known.agg(*sums).first())

    def fit_each(self, rows, key, space, target):
        known, sums = self._sums(rows, space, target)
        told = {r[key]: r for r in known.groupBy(key).agg(*sums).collect()}

        def of(k: int) -> Linear:
            out = Linear()
            out.ids = self.ids
            return out._of(told.get(k, {"n": 0}))

        return of

    def _sums(self, archive: DataFrame, space: Space, target: str) -> tuple[DataFrame, list[Column]]:
        """The complete rows and all entries of their normal equations."""
        self.ids = [p.id for p in space.params if p.numeric]
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in self.ids)]
        y = F.col(target).cast("double")
        sums = {f"x{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))} | {f"y{i}": F.sum(x[i] * y) for i in range(len(x))} | {"yy": F.sum(y * y), "n": F.count("*")}
        return archive.dropna(subset=[*self.ids, target]), [c.alias(k) for k, c in sums.items()]

    def _of(self, row) -> Linear:
        if not row["n"]:
            raise SurrogateError("no complete rows to fit")
        n = len(self.ids) + 1
        a = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        b = np.array([row[f"y{i}"] for i in range(n)])
        self.coef = np.linalg.lstsq(a, b, rcond=None)[0]
        left = max(0.0, row["yy"] - float(self.coef @ b))
        self.se = float(np.sqrt(left / max(row["n"] - n, 1)))
        return self

    def form(self):
        return self.coef, self.ids

    def predict(self, rows):
        mean = F.lit(float(self.coef[0]))
        for c, w in zip(self.ids, self.coef[1:]):
            mean = mean + F.lit(float(w)) * F.col(c).cast("double")
        return rows.withColumn("mean", mean).withColumn("se", F.lit(self.se))


class NearestNeighbours(Surrogate):
    """Mean and deviation of the k nearest archive rows; ties go by ids."""

    def __init__(self, k: int = 5, dist: Distance | str = "standardize"):
        self.k, self.distance = k, distance(dist) if isinstance(dist, str) else dist

    def fit(self, archive, space, target):
        self.distance.fit(archive, space).set_references(archive.withColumn("ref_y", F.col(target).cast("double")), ("ref_y",))
        self.ids = space.ids
        return self

    def neighbours(self, rows: DataFrame) -> DataFrame:
        """rows with their neighbours' outputs, nearest first."""
        d = self.distance
        if d.geometric:
            return self._blocked(rows)
        one = lambda r: F.struct(F.round(d.between(r), 9).alias("d"), *(r[c].alias(f"k{i}") for i, c in enumerate(self.ids)), r["ref_y"].alias("y"))
        first = lambda a: F.slice(F.array_sort(a), 1, self.k)
        return d.fold(rows, "near", lambda refs: first(F.transform(refs, one)), lambda a, b: first(F.concat(a, b))).withColumn("near", F.transform("near", lambda x: x["y"]))

    def _blocked(self, rows: DataFrame) -> DataFrame:
        """The same for few references, sent to all tasks in the order of their ids; more are met by pivots."""
        k, d = self.k, self.distance
        if not few(d.references, NEAR):
            refs = placed(d.references, [*self.ids, "ref_y"])
            own = nearest(rows, d.stored(), refs, d.stored(), k, ("place", "ref_y"), True, "near", Euclidean(d.scales()))
            return own.withColumn("near", F.transform("near", lambda x: x["ref_y"]))

        def first(d2: np.ndarray, _, y: np.ndarray) -> np.ndarray:
            m = min(k, d2.shape[1])
            near = np.round(np.sqrt(d2), 9)
            row, place = np.nonzero(near <= np.partition(near, m - 1, axis=1)[:, m - 1 : m])  # with all ties
            order = np.lexsort((place, near[row, place], row))
            row, place = row[order], place[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            out = np.full((d2.shape[0], 2 * k), np.nan)
            out[row[rank < m], rank[rank < m]] = near[row, place][rank < m]
            out[row[rank < m], k + rank[rank < m]] = y[place[rank < m], 0]
            return out

        rows = d.over_references(rows, "found__", first, lambda a, b: a, [f"{c}{i}" for c in "dy" for i in range(k)])
        found = F.array(*(F.when(F.col(f"found__.d{i}").isNotNull(), F.struct(F.col(f"found__.y{i}").alias("y"))) for i in range(k)))
        return rows.withColumn("near", F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: x["y"])).drop("found__")

    def predict(self, rows):
        near, n = F.col("near"), F.size("near")
        mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / n
        rows = self.neighbours(rows).withColumn("mean", mean)
        spread = F.aggregate(near, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
        return rows.withColumn("se", F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0)).drop("near")


class QuantileNeighbours(NearestNeighbours):
    """The median of the nearest rows, and (upper - lower quantile) * factor as se."""

    def __init__(self, k: int = 20, lower: float = 0.1, middle: float = 0.5, upper: float = 0.9, factor: float = 0.5, dist: Distance | str = "standardize"):
        if not lower < upper:
            raise SurrogateError("the lower quantile must be below the upper")
        super().__init__(k, dist)
        self.at, self.factor = (lower, middle, upper), factor

    def predict(self, rows):
        rows = self.neighbours(rows).withColumn("near", F.array_sort("near"))

        def quantile(q: float):
            place = F.lit(q) * (F.size("near") - 1)
            low = F.floor(place)
            a, b = F.get("near", low.cast("int")), F.get("near", F.ceil(place).cast("int"))
            return a + (b - a) * (place - low)

        lo, mid, hi = map(quantile, self.at)
        return rows.withColumn("mean", mid).withColumn("se", (hi - lo) * F.lit(self.factor)).drop("near")


class Trees(Surrogate):
    """A regression tree (trees=1) or forest of MLlib over the standardized embedding; no se of its own."""

    has_se = False

    def __init__(self, trees: int = 1, depth: int = 5, seed: int = 1):
        self.trees, self.depth, self.seed = trees, depth, seed

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("features_vec", array_to_vector(F.array(*self.embed.embedding())))

    def fit(self, archive, space, target):
        from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

        self.embed = Standardize().fit(archive, space)
        args = {"featuresCol": "features_vec", "labelCol": "label_y", "predictionCol": "mean", "maxDepth": self.depth, "seed": self.seed}
        rows = self._vectors(archive.withColumn("label_y", F.col(target).cast("double"))).select("features_vec", "label_y")
        self.model = (DecisionTreeRegressor(**args) if self.trees == 1 else RandomForestRegressor(numTrees=self.trees, **args)).fit(rows)
        return self

    def predict(self, rows):
        return self.model.transform(self._vectors(rows)).drop("features_vec").withColumn("se", F.lit(None).cast("double"))


class Bootstrap(Surrogate):
    """Mean and deviation over models fitted on resamples of the archive, drawn with replacement by a hash.

    Models that follow from sums are fitted together: all resamples' slots meet
    the archive in one join, and one aggregation by resample gives the sums.
    Where all models are linear, so is their mean, and their variance is a
    quadratic form with as many terms as coefficients, however many models.
    """

    def __init__(self, base: Callable[[], Surrogate], n: int = 30, seed: int = 1):
        if n < 2:
            raise SurrogateError("at least two resamples are needed")
        self.base, self.n, self.seed = base, n, seed

    def fit(self, archive, space, target):
        rows = checkpointed(placed(archive, [*space.ids, target]))
        count = rows.count()
        of = self.base().fit_each(drawn_each(rows, count, self.n, self.seed), "resample__", space, target)
        self.models = [of(b) if of else self.base().fit(drawn(rows, count, b, self.seed), space, target) for b in range(self.n)]
        return self

    def predict(self, rows):
        forms = [m.form() for m in self.models]
        if all(f is not None for f in forms):
            return self._linear(rows, np.array([f[0] for f in forms]), forms[0][1])
        for b, model in enumerate(self.models):
            rows = model.predict(rows).withColumnRenamed("mean", f"mean__{b}").drop("se")
        means = [F.col(f"mean__{b}") for b in range(self.n)]
        mean = sum(means[1:], means[0]) / self.n
        square = sum(((m - F.col("mean")) * (m - F.col("mean")) for m in means[1:]), (means[0] - F.col("mean")) * (means[0] - F.col("mean")))
        return rows.withColumn("mean", mean).withColumn("se", F.sqrt(square / (self.n - 1))).drop(*(f"mean__{b}" for b in range(self.n)))

    def _linear(self, rows: DataFrame, coef: np.ndarray, ids: list[str]) -> DataFrame:
        """Means are the mean coefficients'; the triangular factor of the coefficients' deviations gives the variance as a sum of squares."""
        mean = coef.mean(axis=0)
        factor = np.linalg.qr((coef - mean) / np.sqrt(self.n - 1), mode="r")
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in ids)]

        def at(weights: np.ndarray) -> Column:
            return sum((F.lit(float(w)) * v for w, v in zip(weights[1:], x[1:])), F.lit(float(weights[0])))

        told = F.struct(at(mean).alias("mean"), F.sqrt(sum((at(r) * at(r) for r in factor[1:]), at(factor[0]) * at(factor[0]))).alias("se"))
        return rows.withColumn("told__", told).withColumns({"mean": F.col("told__.mean"), "se": F.col("told__.se")}).drop("told__")


def placed(archive: DataFrame, order: list[str]) -> DataFrame:
    """archive with each row's place in that order, from 0: sorted by ranges, each range's count added to the places of the next."""
    keys = by_key(order)
    rows = archive.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"range__": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    rows = checkpointed(rows)
    counts, before = rows.groupBy("range__").count().orderBy("range__").collect(), 0  # a row for each partition
    first = []
    for r in counts:
        first.append((r["range__"], before - (r["range__"] << 33)))
        before += r["count"]
    starts = archive.sparkSession.createDataFrame(first, "range__ int, first__ bigint")
    return rows.join(F.broadcast(starts), "range__").withColumn("place", F.col("place") + F.col("first__")).drop("range__", "first__")


def _slot(b: Column, slot: Column, n: int, seed: int) -> Column:
    """The place that a slot of round b draws."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), slot.cast("string"))), 1, 12), 16, 10).cast("bigint"), F.lit(max(n, 1))).alias("place")


def drawn(rows: DataFrame, n: int, b: int, seed: int, slots: int | None = None) -> DataFrame:
    """So many rows (n of them, if not told) drawn with replacement in round b from n placed() rows: each slot's MD5 is a place."""
    asked = rows.sparkSession.range(n if slots is None else slots).select(_slot(F.lit(b), F.col("id"), n, seed))
    return rows.join(asked, "place").drop("place")


def drawn_each(rows: DataFrame, n: int, rounds: int, seed: int) -> DataFrame:
    """The rows of drawn() for rounds 0, 1, ... with their round in resample__; one join for all."""
    b, slot = F.expr(f"id div {max(n, 1)}"), F.col("id") % max(n, 1)
    asked = rows.sparkSession.range(n * rounds).select(_slot(b, slot, n, seed), b.cast("int").alias("resample__"))
    return rows.join(asked, "place").drop("place")


def resample(archive: DataFrame, order: list[str], b: int, seed: int = 1) -> DataFrame:
    """As many rows as the archive has, drawn with replacement: the slot's MD5 picks a row by its place in order."""
    rows = placed(archive, order)
    return drawn(rows, rows.count(), b, seed)


def ensemble_summary(draws: DataFrame, ids: list[str], mean: str = "mu", variance: str = "s2") -> DataFrame:
    """(ids, mean, se) of several draws: the mean variance and the variance of means add up; negative variances count as 0."""
    total = F.avg(variance) + F.coalesce(F.var_samp(F.when(~F.isnan(mean), F.col(mean))), F.lit(0.0))
    return draws.groupBy(*ids).agg(F.avg(mean).alias("mean"), F.sqrt(F.greatest(total, F.lit(0.0))).alias("se"))

