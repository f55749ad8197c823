"""Acquisition scores: what is worth evaluating next. Higher is better."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import anti, block, checkpointed, few, over_block, usable
from siftpool.operators.distance import Distance, distance
from siftpool.operators.nearest import nearest
from siftpool.space import Space


class AcquisitionError(ValueError):
    pass


class Acquisition:
    """fit() on a pool, update() with the archive, then score() candidates that may carry predictions mean and se."""

    key, needs_surrogate, needs_distance = "", False, False

    def fit(self, pool: DataFrame | None, space: Space) -> Acquisition:
        self.space = space
        return self

    def update(self, archive: DataFrame, target: str) -> Acquisition:
        self.archive, self.target = archive, target
        return self

    def score(self, cands: DataFrame, out: str = "score") -> DataFrame:
        raise NotImplementedError

    def begin(self, cands: DataFrame, out: str = "score") -> DataFrame:
        """score(), with what absorb() needs of the references that there are."""
        return self.score(cands, out)

    def absorb(self, rows: DataFrame, row: dict, out: str = "score") -> DataFrame:
        """rows of begin() with their scores after one more reference: values of the ids and, in mean, of its output."""
        raise AcquisitionError(f"acquisition '{self.key}' takes no references one by one")


class DistanceAcquisition(Acquisition):
    """Scores by distance to all archive rows, repeats included."""

    needs_distance = True

    def __init__(self, dist: Distance | str = "standardize"):
        self.distance = distance(dist) if isinstance(dist, str) else dist

    def fit(self, pool, space):
        self.distance.fit(pool, space)
        return super().fit(pool, space)

    def update(self, archive, target):
        self.distance.set_references(archive.withColumn("ref_y", F.col(target).cast("double") if target in archive.columns else F.lit(None).cast("double")), ("ref_y",))
        return super().update(archive, target)

    def _refs(self) -> None:
        if self.distance.references is None or self.distance.references.isEmpty():
            raise AcquisitionError("no reference points")


class GSx(DistanceAcquisition):
    """Distance to the nearest evaluated row."""

    key = "dist_gsx"

    def score(self, cands, out="score"):
        self._refs()
        return self.distance.nearest(cands, out)

    def absorb(self, rows, row, out="score"):
        return rows.withColumn(out, F.least(out, self.distance.to(row)))


class IGS(DistanceAcquisition):
    """The smallest product of distance and difference of the predicted from an evaluated output."""

    key, needs_surrogate = "dist_igs", True

    def score(self, cands, out="score"):
        self._refs()
        if self.distance.geometric:
            own = self.distance.over_references(cands, "least__", lambda d2, mean, y: np.fmin.reduce(np.sqrt(d2) * np.abs(mean - y[:, :1].T), axis=1), np.fmin, ["d"], ("mean",), counted=True)
            return own.withColumn(out, F.col("least__.d")).drop("least__")
        return self.distance.fold(cands, out, lambda refs: F.array_min(F.transform(refs, lambda r: self.distance.between(r) * F.abs(F.col("mean") - r["ref_y"]))), F.least)

    def absorb(self, rows, row, out="score"):
        return rows.withColumn(out, F.least(out, self.distance.to(row) * F.abs(F.col("mean") - F.lit(row["mean"]))))


class GSy(Acquisition):
    """The smallest difference of the predicted from an evaluated output, by binary search among the sorted outputs; null without any."""

    key, needs_surrogate = "gsy", True

    def score(self, cands, out="score"):
        if self.archive.isEmpty():
            raise AcquisitionError("no reference points")
        told = self.archive.select(usable(F.col(self.target)).alias("y")).where("y is not null").distinct()
        if not few(told):  # outputs as points of a line, met by ranges of them
            mean = F.coalesce(usable(F.col("mean")), F.lit(0.0))
            near = nearest(cands, [mean], told, [F.col("y")], 1, (), False, "least__")
            return near.withColumn(out, F.when(usable(F.col("mean")).isNotNull(), F.col("least__")[0]["d"])).drop("least__")
        refs = block(told, [F.col("y")], [F.col("y")])

        def least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            if not len(y):
                return np.full(len(x), np.nan)
            at = np.searchsorted(y[:, 0], x[:, 0])
            return np.minimum(np.abs(x[:, 0] - y[np.maximum(at - 1, 0), 0]), np.abs(x[:, 0] - y[np.minimum(at, len(y) - 1), 0]))

        return cands.withColumn(out, usable(over_block(refs, least, [F.col("mean")], cands.sparkSession)))

    def absorb(self, rows, row, out="score"):
        return rows.withColumn(out, F.least(out, F.abs(F.col("mean") - F.lit(row["mean"]))))


def _sums(tolerance: float):
    """Exact matches, their residuals, the largest log weight, and sums relative to it, of a block of squared distances; y: outputs, and how many references are like that."""

    def of(d2: np.ndarray, mean: np.ndarray, y: np.ndarray) -> np.ndarray:
        exact, res, n = d2 <= tolerance, (mean - y[:, :1].T) ** 2, y[:, 1]
        with np.errstate(divide="ignore"):
            lw = np.where(exact, -1e308, -d2 - np.log(d2))
        m = lw.max(axis=1)
        w = np.where(exact, 0.0, np.exp(lw - m[:, None]) * n)
        return np.column_stack([(exact * n).sum(axis=1), np.where(exact, res * n, 0.0).sum(axis=1), m, w.sum(axis=1), (w * res).sum(axis=1)])

    return of


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two blocks, relative to the larger weight."""
    m = np.maximum(a[:, 2], b[:, 2])
    fa, fb = np.exp(a[:, 2] - m), np.exp(b[:, 2] - m)
    return np.column_stack([a[:, 0] + b[:, 0], a[:, 1] + b[:, 1], m, a[:, 3] * fa + b[:, 3] * fb, a[:, 4] * fa + b[:, 4] * fb])


class Ideal(DistanceAcquisition):
    """Inverse-distance weighted residuals plus delta times a distance term, in log space.

    Where a reference is within the tolerance (on squared distance), the mean of
    squared residuals there. With omega, scores grow with a candidate's density
    in the fitted pool: omega times the density is added to a factor of 1.
    """

    key, needs_surrogate = "dist_ideal", True

    def __init__(self, dist: Distance | str = "standardize", delta: float = 1.0, omega: float = 0.0, tolerance: float = 1e-12):
        super().__init__(dist)
        self.delta, self.omega, self.tolerance, self.density = delta, omega, tolerance, None

    def fit(self, pool, space):
        super().fit(pool, space)
        self.pooled = pool is not None
        self.density = density(pool, self.distance, space) if self.omega > 0 and pool is not None else None
        return self

    def _partial(self, refs: Column) -> Column:
        """(exact matches, their residuals, largest log weight, sums relative to it) of one array."""
        seen = F.transform(refs, lambda r: F.struct(F.pow(self.distance.between(r), 2).alias("d2"), F.pow(F.col("mean") - r["ref_y"], 2).alias("res")))
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("e"), F.lit(-1e308).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("r"))

        def add(acc: Column, x: Column) -> Column:
            exact = x["d2"] <= self.tolerance
            lw = F.when(exact, F.lit(-1e308)).otherwise(-x["d2"] - F.ln(x["d2"]))
            one = F.struct(exact.cast("double").alias("n"), F.when(exact, x["res"]).otherwise(0.0).alias("e"), lw.alias("m"), F.when(exact, 0.0).otherwise(1.0).alias("s"), F.when(exact, 0.0).otherwise(x["res"]).alias("r"))
            return self._join(acc, one)

        return F.aggregate(seen, zero, add)

    @staticmethod
    def _join(a: Column, b: Column) -> Column:
        m = F.greatest(a["m"], b["m"])
        fa, fb = F.exp(a["m"] - m), F.exp(b["m"] - m)
        return F.struct((a["n"] + b["n"]).alias("n"), (a["e"] + b["e"]).alias("e"), m.alias("m"), (a["s"] * fa + b["s"] * fb).alias("s"), (a["r"] * fa + b["r"] * fb).alias("r"))

    def score(self, cands, out="score"):
        return self.begin(cands, out).drop("ideal_sums", "density")

    def begin(self, cands, out="score"):
        self._refs()
        if self.distance.geometric:
            cands = self.distance.over_references(cands, "ideal_sums", _sums(self.tolerance), _added, ["n", "e", "m", "s", "r"], ("mean",), counted=True)
        else:
            cands = self.distance.fold(cands, "ideal_sums", self._partial, self._join)
        if self.omega > 0:
            if self.density is None and self.pooled:
                raise AcquisitionError("call fit_pool first")
            cands = self._with_density(cands)
        return cands.withColumn(out, self._value())

    def absorb(self, rows, row, out="score"):
        d2 = F.pow(self.distance.to(row), 2)
        exact, left = d2 <= self.tolerance, F.pow(F.col("mean") - F.lit(row["mean"]), 2)
        one = F.struct(
            exact.cast("double").alias("n"),
            F.when(exact, left).otherwise(0.0).alias("e"),
            F.when(exact, F.lit(-1e308)).otherwise(-d2 - F.ln(F.when(exact, F.lit(1.0)).otherwise(d2))).alias("m"),
            F.when(exact, 0.0).otherwise(1.0).alias("s"),
            F.when(exact, 0.0).otherwise(left).alias("r"),
        )
        return rows.withColumn("ideal_sums", self._join(F.col("ideal_sums"), one)).withColumn(out, self._value())

    def _value(self) -> Column:
        x = F.col("ideal_sums")
        z = F.lit(2 / math.pi) * F.atan(F.exp(-(x["m"] + F.ln(x["s"]))))
        plain = F.when(x["n"] > 0, x["e"] / F.greatest(x["n"], F.lit(1.0))).when(x["s"] > 0, x["r"] / F.greatest(x["s"], F.lit(1e-300)) + F.lit(float(self.delta)) * z).otherwise(F.lit(float(self.delta)))
        return plain * (F.lit(1.0) + F.lit(float(self.omega)) * F.col("density")) if self.omega > 0 else plain

    def _with_density(self, cands: DataFrame) -> DataFrame:
        if self.density is None:
            return cands.withColumn("density", F.lit(1.0))
        ids = self.space.ids
        if not anti(cands.select(ids), self.density, ids).isEmpty():
            raise AcquisitionError("candidates must be in the fitted pool")
        known = self.density.toDF(*(f"{c}__d" for c in ids), "density")
        cond = F.lit(True)
        for c in ids:
            cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__d"))
        return cands.join(known, cond).drop(*(f"{c}__d" for c in ids))


class Uncertainty(Acquisition):
    """The surrogate's standard error."""

    key, needs_surrogate = "sd", True

    def score(self, cands, out="score"):
        return cands.withColumn(out, F.col("se"))


def density(pool: DataFrame, dist: Distance, space: Space) -> DataFrame:
    """Rows (ids, density) of the distinct pool rows: 1 for the densest, less with the mean distance to the nearest others, to the power of the dimension.

    Geometric distances find the nearest by pivots, without a distance between
    all pairs; others meet the pool in arrays of bounded size.
    """
    rows = space.project(pool).distinct()
    n = rows.count()
    dim = dist.dimension if dist.geometric else len(space.ids)
    k = min(dim, n - 1)
    if k < 1:
        return rows.withColumn("density", F.lit(1.0))
    kept = dist.references, dist._carried
    dist.set_references(rows)
    if dist.geometric:
        near = dist.neighbours(rows, k + 1).withColumn("near", F.transform("near", lambda x: x["d"]))
    else:
        near = dist.fold(rows, "near", lambda refs: F.slice(F.array_sort(F.transform(refs, dist.between)), 1, k + 1), lambda a, b: F.slice(F.array_sort(F.concat(a, b)), 1, k + 1))
    dist.references, dist._carried = kept
    power = F.pow(F.aggregate(F.slice("near", 2, k), F.lit(0.0), lambda a, x: a + x) / k, F.lit(dim))
    near = checkpointed(near.select(*space.ids, power.alias("power")))
    least = near.agg(F.min(F.when(F.col("power") > 0, F.col("power")))).first()[0]
    value = F.when(F.col("power") > 0, F.lit(least) / F.col("power")).otherwise(1.0) if least is not None else F.lit(1.0)
    return near.select(*space.ids, value.alias("density"))


ACQUISITIONS = {c.key: c for c in (GSx, IGS, Ideal, GSy, Uncertainty)}


def acquisition(key: str, **args) -> Acquisition:
    return ACQUISITIONS[key](**args)

