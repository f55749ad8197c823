"""Linear quantile regression by smoothed Newton steps, each one aggregation of the archive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import checkpointed
from siftpool.operators.surrogates import Surrogate, SurrogateError

NARROWEST = 1e-5  # width of smoothing at last, in deviations of the target
SHORTEST = 2.0**-20  # of a step, before a width counts as done
ALIKE = 1e-7  # relative change of the loss between widths, below which no narrower one is tried


class _Plane:
    """The search for one quantile: the absolute loss is rounded off within a width of 0, which shrinks whenever Newton's steps have reached the bottom."""

    def __init__(self, at: float, start: np.ndarray):
        self.at, self.trial, self.width = at, start, 1.0
        self.best, self.least, self.before = start, np.inf, np.inf
        self.smooth, self.open = np.inf, True

    def learn(self, smooth: float, plain: float, g: np.ndarray, h: np.ndarray) -> None:
        """Takes the losses and derivatives at the trial and sets the next trial, or closes the search."""
        n = len(self.trial)
        if plain < self.least:
            self.least, self.best = plain, self.trial
        if smooth < self.smooth:
            self.here, self.smooth, self.step = self.trial, smooth, 1.0
            d = -np.linalg.solve(h + (1e-10 + 1e-9 * np.trace(h)) * np.eye(n), g)
            self.way = d / max(1.0, float(np.linalg.norm(d)))
            if -g @ self.way <= 1e-3 * ALIKE * smooth:
                return self._narrow()
        else:
            self.step /= 4
            if self.step < SHORTEST:
                return self._narrow()
        self.trial = self.here + self.step * self.way

    def _narrow(self) -> None:
        self.open = self.width > NARROWEST and self.before - self.least > ALIKE * self.least
        self.before, self.trial, self.smooth = self.least, self.here, np.inf
        self.width /= 4


def _sums(planes: list[tuple[float, np.ndarray, float]]):
    """What a task tells of its rows: for each plane the smoothed and the plain loss, the smoothed one's gradient and second derivative."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(planes[0][1])
        total = np.zeros((len(planes), 2 + size + size * size))
        for b in batches:
            y = b.column(size - 1).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(y)), *(b.column(i).to_numpy(zero_copy_only=False) for i in range(size - 1))])
            for out, (at, coef, width) in zip(total, planes):
                r = y - x @ coef
                far, inside = np.abs(r), np.abs(r) <= width
                slope = np.where(inside, r / (2 * width), np.sign(r) / 2) + (at - 0.5)
                out[0] += np.where(inside, r * r / (4 * width) + width / 4, far / 2).sum() + (at - 0.5) * r.sum()
                out[1] += far.sum() / 2 + (at - 0.5) * r.sum()
                out[2 : 2 + size] -= x.T @ slope
                out[2 + size :] += (x[inside].T @ x[inside]).ravel() / (2 * width)
        yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    return of


class LinearQuantiles(Surrogate):
    """A plane for each of three quantiles: the middle one is the mean, (upper - lower) * factor the se, 0 where planes cross.

    All planes are fitted together to the complete rows, over numeric
    parameters, standardized. A step reads the rows once and leaves sums of as
    many numbers as coefficients squared, whatever the number of rows; they are
    written once to the shared folder, with these columns only. The loss is
    the exact one up to about ALIKE; where several planes have the least loss,
    any of them may be the result. Parameters without spread count for nothing.
    """

    def __init__(self, lower: float = 0.1, middle: float = 0.5, upper: float = 0.9, factor: float = 0.5, passes: int = 100):
        if not 0 < lower < upper < 1 or not 0 < middle < 1:
            raise SurrogateError("quantiles are between 0 and 1, the lower below the upper")
        self.at, self.factor, self.passes = (lower, middle, upper), factor, passes

    def fit(self, archive, space, target):
        ids = [p.id for p in space.params if p.numeric]
        known = archive.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(ids)), F.col(target).cast("double").alias("y")).dropna()
        names = [f"x{i}" for i in range(len(ids))] + ["y"]
        told = known.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop))).first()
        if not told["n"]:
            raise SurrogateError("no complete rows to fit")
        middle = {c: told[f"avg_{c}"] for c in names}
        spread = {c: told[f"stddev_pop_{c}"] for c in names}
        used = [c for c in names[:-1] if spread[c] > 1e-12 * max(1.0, abs(middle[c]))]
        unit = spread["y"] or 1.0
        rows = checkpointed(known.select(*((F.col(c) - middle[c]) / spread[c] for c in used), ((F.col("y") - middle["y"]) / unit)).toDF(*used, "y"))
        planes = self._planes(rows, used)
        self.ids = [ids[int(c[1:])] for c in used]
        self.coef = []
        for b in planes:
            w = np.array([unit * v / spread[c] for v, c in zip(b[1:], used)])
            self.coef.append(np.array([middle["y"] + unit * b[0] - sum(v * middle[c] for v, c in zip(w, used)), *w]))
        return self

    def _planes(self, rows: DataFrame, used: list[str]) -> list[np.ndarray]:
        planes, n, size = [_Plane(q, np.zeros(len(used) + 1)) for q in self.at], rows.count(), len(used) + 1
        for _ in range(self.passes):
            going = [p for p in planes if p.open]
            if not going:
                break
            told = rows.mapInArrow(_sums([(p.at, p.trial, p.width) for p in going]), "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum")).collect()
            means = np.zeros(len(told))
            means[[r["pos"] for r in told]] = [r["sum"] / n for r in told]
            for p, m in zip(going, means.reshape(len(going), -1)):
                p.learn(float(m[0]), float(m[1]), m[2 : 2 + size], m[2 + size :].reshape(size, size))
        return [p.best for p in planes]

    def predict(self, rows):
        x = [F.col(c).cast("double") for c in self.ids]
        lo, mid, hi = (sum((F.lit(float(w)) * v for w, v in zip(b[1:], x)), F.lit(float(b[0]))) for b in self.coef)
        told = F.struct(mid.alias("mean"), F.greatest((hi - lo) * F.lit(self.factor), F.when((hi - lo).isNotNull(), F.lit(0.0))).alias("se"))
        return rows.withColumn("told__", told).withColumns({"mean": F.col("told__.mean"), "se": F.col("told__.se")}).drop("told__")
