"""Gaussian process surrogates on the whole archive, by inducing points.

The archive is merged by design point (count, sum and sum of squares of the target)
and written once. All that a fit reads from it are sums over design points of
products of kernel values with the inducing points: one aggregation gives them, and
their derivatives, for several trial length scales at once. Amplitude and noise
follow from the sums alone. Where the inducing points are all design points, the
model is the exact Gaussian process.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import checkpointed
from siftpool.operators.surrogates import Surrogate, SurrogateError
from siftpool.space import Space

CANDIDATES = 20  # candidates for each inducing point
EPS = np.finfo(float).eps
STARTS = (0.1, 0.2, 0.4, 0.8, 1.6)  # length scales that are tried first, in the unit cube
SHORT, LONG = 0.02, 20.0  # bounds of length scales
TRIALS = (1.0, 0.3, 0.1, 0.03)  # parts of a step that are tried at once
QUIET, LOUD = 1e-6, 1e2  # bounds of the noise variance over the amplitude
_SUMMED_BY = 8  # tasks that add up what the others send
_CHUNK = 4096


class Kernel:
    """Correlation of points by distances over length scales: "matern" (5/2), or "exponential" with a power from 0 to 2 for each coordinate."""

    def __init__(self, kind: str = "matern", power: float = 1.95):
        if kind not in ("matern", "exponential"):
            raise SurrogateError("a kernel is 'matern' or 'exponential'")
        if not 0 < power <= 2:
            raise SurrogateError("the power is above 0 and 2 at most")
        self.kind, self.power = kind, power

    def __call__(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.slopes(a, b, lengths, False)[0]

    def slopes(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, wanted: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """Correlations, and their derivatives by the logarithm of each length scale."""
        apart = [np.abs(a[:, j, None] - b[None, :, j]) / lengths[j] for j in range(a.shape[1])]
        if self.kind == "exponential":
            parts = [x**self.power for x in apart]
            k = np.exp(-sum(parts))
            return k, [self.power * k * p for p in parts] if wanted else []
        parts = [x * x for x in apart]
        r = np.sqrt(5 * sum(parts))
        fall = np.exp(-r)
        return (1 + r + r * r / 3) * fall, [5 / 3 * (1 + r) * fall * p for p in parts] if wanted else []


@dataclass
class Sums:
    """What a fit knows of the archive: sums over its rows of w k k', w y k, w y^2, w, 1 and log of the noise, with derivatives of the first two by each log length."""

    a: np.ndarray
    b: np.ndarray
    yy: float
    w: float
    n: float
    log_noise: float
    da: list[np.ndarray] = field(default_factory=list)
    db: list[np.ndarray] = field(default_factory=list)


def design_points(rows: DataFrame, x: list[Column], target: Column) -> DataFrame:
    """Rows (x array, n, sy, syy), one for each design point; rows with an unknown coordinate or target are left out."""
    own = rows.select(F.array(*(c.cast("double") for c in x)).alias("x"), target.cast("double").alias("y"))
    own = own.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c)) & F.col("y").isNotNull() & ~F.isnan("y"))
    return own.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def normal_sums(points: DataFrame, z: np.ndarray, lengths: list[np.ndarray], kernel: Kernel, slopes: bool = True) -> list[Sums]:
    """Sums for each vector of length scales, in one aggregation over design points with columns x, n, sy, syy and noise (relative variance of a row)."""
    m, d = z.shape
    each = 1 + d if slopes else 1
    size = each * (m * m + m) + 4

    def task(batches):
        total = np.zeros((len(lengths), size))
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(start, _CHUNK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                n, sy, syy, noise = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n", "sy", "syy", "noise"))
                for t, own in enumerate(lengths):
                    k, dk = kernel.slopes(x, z, own, slopes)
                    weighted = k * (n / noise)[:, None]
                    half = [weighted.T @ v for v in dk]
                    parts = [weighted.T @ k, *(h + h.T for h in half), (sy / noise) @ k, *((sy / noise) @ v for v in dk), [(syy / noise).sum(), (n / noise).sum(), n.sum(), (n * np.log(noise)).sum()]]
                    total[t] += np.concatenate([np.ravel(p) for p in parts])
        yield told(total)

    def added(batches):
        total = np.zeros((len(lengths), size))
        for batch in batches:
            for v in batch.column("v"):
                total += np.frombuffer(v.as_buffer()).reshape(total.shape)
        yield told(total)

    def told(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sent = points.select("x", "n", "sy", "syy", "noise").mapInArrow(task, "v binary")
    got = sent.repartition(_SUMMED_BY).mapInArrow(added, "v binary").collect()  # _SUMMED_BY rows
    total = sum((np.frombuffer(bytes(r.v)).reshape(len(lengths), size) for r in got), np.zeros((len(lengths), size)))
    out = []
    for row in total:
        square = row[: each * m * m].reshape(each, m, m)
        line = row[each * m * m : -4].reshape(each, m)
        out.append(Sums(square[0], line[0], *row[-4:], list(square[1:]), list(line[1:])))
    return out


@dataclass
class Fitted:
    """A sparse Gaussian process with length scales, amplitude s2 and noise g over it; bound is the lower bound of its log likelihood, exact if z are all design points."""

    z: np.ndarray
    lengths: np.ndarray
    kernel: Kernel
    sums: Sums
    g: float = 0.0
    s2: float = 0.0
    bound: float = -np.inf
    slope: np.ndarray | None = None

    def __post_init__(self):
        k, dk = self.kernel.slopes(self.z, self.z, self.lengths)
        m, s = len(self.z), self.sums
        fuzz = max(1e-8, float(np.sqrt(EPS * s.w)))  # rounding of the sums, blown up by 1 / fuzz, stays below the least noise
        k = k + fuzz * np.eye(m)
        low = np.linalg.cholesky(k)
        half = np.linalg.solve(low, np.linalg.solve(low, s.a).T)
        values, vectors = np.linalg.eigh((half + half.T) / 2)
        values = np.maximum(values, 0)
        c2 = (vectors.T @ np.linalg.solve(low, s.b)) ** 2
        left = max(s.w - values.sum(), 0.0)  # what the inducing points do not explain

        def bounds(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            quad = np.maximum(s.yy - (c2[:, None] / (values[:, None] + g)).sum(axis=0), 1e-300) / g
            s2 = np.maximum(quad / s.n, 1e-300)
            det = np.log(values[:, None] + g).sum(axis=0) + (s.n - m) * np.log(g) + s.log_noise
            return -s.n / 2 * (np.log(2 * np.pi * s2) + 1) - det / 2 - left / (2 * g), s2

        grid = np.exp(np.linspace(np.log(max(QUIET, 10 * EPS * s.w / fuzz)), np.log(LOUD), 200))
        for _ in range(3):
            at, _ = bounds(grid)
            i = int(np.argmax(at))
            grid = np.exp(np.linspace(np.log(grid[max(i - 1, 0)]), np.log(grid[min(i + 1, len(grid) - 1)]), 41))
        at, s2 = bounds(grid)
        i = int(np.argmax(at))
        self.g, self.s2, self.bound = float(grid[i]), float(s2[i]), float(at[i])

        self.inverse = np.linalg.inv(k)
        self.posterior = np.linalg.inv(self.g * k + s.a)
        self.weights = self.posterior @ s.b
        if s.da:
            v, fixed, p, g = self.weights, self.inverse, self.posterior, self.g
            slope = []
            for dkj, da, db in zip(dk, s.da, s.db):
                ds = g * dkj + da
                quad = -(2 * v @ db - v @ ds @ v)
                slope.append(-0.5 * np.sum(p * ds) + 0.5 * np.sum(fixed * dkj) - quad / (2 * self.s2 * g) + (np.sum(fixed * da) - np.sum((fixed @ s.a @ fixed) * dkj)) / (2 * g))
            self.slope = np.array(slope)

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the process at points."""
        k = self.kernel(x, self.z, self.lengths)
        var = 1 - np.einsum("ij,jk,ik->i", k, self.inverse, k, optimize=True) + self.g * np.einsum("ij,jk,ik->i", k, self.posterior, k, optimize=True)
        return k @ self.weights, self.s2 * np.maximum(var, 0)


def inducing_points(points: DataFrame, m: int) -> np.ndarray:
    """m design points that leave little to explain (all, if there are no more): pivoted Cholesky on CANDIDATES * m of them, chosen by hash."""
    rows = points.select("x").orderBy(F.xxhash64("x"), "x").limit(CANDIDATES * m).collect()
    x = np.array([r.x for r in rows], float)
    if len(x) <= m:
        return x[np.lexsort(x.T[::-1])]
    kernel, length = Kernel(), np.full(x.shape[1], 0.4)
    left, basis, picked = np.ones(len(x)), np.zeros((len(x), m)), []
    for i in range(m):
        j = int(np.argmax(left))
        picked.append(j)
        column = (kernel(x, x[j : j + 1], length)[:, 0] - basis[:, :i] @ basis[j, :i]) / np.sqrt(max(left[j], 1e-12))
        basis[:, i] = column
        left = np.maximum(left - column**2, 0)
        left[picked] = -1
    return x[sorted(picked)]


def fitted(points: DataFrame, z: np.ndarray, kernel: Kernel, steps: int, shortest: np.ndarray | float = SHORT) -> Fitted:
    """Length scales of the highest bound, by quasi-Newton steps from the best of STARTS; each step is one aggregation over all design points."""
    d = z.shape[1]
    low, high = np.log(np.broadcast_to(shortest, d).astype(float)), np.full(d, np.log(LONG))

    def tried(many: list[np.ndarray]) -> Fitted:
        scales = [np.exp(v) for v in many]
        return max((Fitted(z, s, kernel, got) for s, got in zip(scales, normal_sums(points, z, scales, kernel))), key=lambda f: f.bound)

    best = tried([np.clip(np.log(np.full(d, s)), low, high) for s in STARTS])
    inverse = np.eye(d)
    for step in range(steps):
        at, slope = np.log(best.lengths), best.slope
        free = ~(((at <= low) & (slope < 0)) | ((at >= high) & (slope > 0)))
        way = np.where(free, inverse @ np.where(free, slope, 0), 0)
        if way @ slope <= 0:
            inverse, way = np.eye(d), np.where(free, slope, 0)
        way = way / max(1.0, np.abs(way).max())  # a length changes by a factor of e at most
        new = tried([np.clip(at + t * way, low, high) for t in TRIALS])
        if new.bound <= best.bound + 1e-5:
            if step and not np.array_equal(inverse, np.eye(d)):
                inverse = np.eye(d)  # once more along the slope
                continue
            break
        s, y = np.log(new.lengths) - at, slope - new.slope
        if s @ y > 1e-12:
            r = np.eye(d) - np.outer(s, y) / (s @ y)
            inverse = r @ inverse @ r.T + np.outer(s, s) / (s @ y)
        best = new
    return best


class GaussianProcess(Surrogate):
    """A Gaussian process on the numeric columns, scaled to the unit cube by the archive; constant columns are dropped.

    All rows of the archive count; rows with a null feature or target are left
    out. inducing points stand for them in the kernel: with as many design
    points or fewer the process is exact. Length scales, one for each column,
    noise and amplitude are those of the highest likelihood bound. se is that of
    the process; with observed, the noise of an observation is added.
    """

    def __init__(self, inducing: int = 100, corr: str = "matern", power: float = 1.95, steps: int = 12, observed: bool = False):
        self.inducing, self.kernel, self.steps, self.observed = inducing, Kernel(corr, power), steps, observed

    def _scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - F.lit(a)) / F.lit(s) for c, a, s in zip(self.ids, self.low, self.span)]

    def _prepared(self, archive: DataFrame, space: Space, target: str) -> DataFrame:
        """The design points in the unit cube, the target to mean 0 and deviation 1, written once."""
        numbers = [p.id for p in space.params if p.numeric]
        known = archive.where(F.col(target).isNotNull())
        for c in [*numbers, target]:
            known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
        y = F.col(target).cast("double")
        row = known.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(numbers) for n, f in (("a", F.min), ("b", F.max))), F.count("*").alias("rows"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd")).first()
        if not row["rows"]:
            raise SurrogateError("no row has all columns and a target")
        kept = [(c, row[f"a_{i}"], row[f"b_{i}"] - row[f"a_{i}"]) for i, c in enumerate(numbers) if row[f"b_{i}"] > row[f"a_{i}"]]
        if not kept:
            raise SurrogateError("all columns are constant")
        self.ids, self.low, self.span = map(list, zip(*kept))
        self.center, self.scale = row["mean"], row["sd"] or 1.0
        return checkpointed(design_points(known, self._scaled(), (y - F.lit(self.center)) / F.lit(self.scale)))

    def fit(self, archive, space, target):
        points = self._prepared(archive, space, target).withColumn("noise", F.lit(1.0))
        self.model = fitted(points, inducing_points(points, self.inducing), self.kernel, self.steps)
        return self

    def _noise(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.model.s2 * self.model.g)

    def predict(self, rows):
        """mean and se; null where a column is null."""
        model, center, scale, noise = self.model, self.center, self.scale, self._noise if self.observed else None

        @F.pandas_udf("mean double, se double")
        def at(*cols: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            mean, se = np.full(len(x), np.nan), np.full(len(x), np.nan)
            known = np.flatnonzero(~np.isnan(x).any(axis=1))
            for start in range(0, len(known), _CHUNK):
                part = known[start : start + _CHUNK]
                mean[part], var = model.at(x[part])
                se[part] = np.sqrt(var + (noise(x[part]) if noise else 0.0))
            told = pd.DataFrame({"mean": center + scale * mean, "se": scale * se})
            return told.astype(object).where(told.notna(), None) if len(known) < len(x) else told

        own = rows.withColumn("gp", at(*self._scaled()))
        return own.withColumn("mean", F.col("gp.mean")).withColumn("se", F.col("gp.se")).drop("gp")


class HeteroskedasticProcess(GaussianProcess):
    """A Gaussian process whose noise depends on the place: the logarithm of the noise is a second process.

    In rounds, each design point tells the noise there by its replicates and by
    how far its mean is from the process (for what the point itself pulled it),
    as the logarithm of a mean square, corrected for the bias and weighted by
    the variance that this has with so many rows. The second process smooths
    these, with length scales of its own (linked: not below the first's), and
    the first is fitted anew with the noise it gives. With check_hom, equal noise stays unless the
    likelihood gains. se contains the noise of an observation unless observed is
    False.
    """

    def __init__(self, inducing: int = 100, corr: str = "matern", power: float = 1.95, steps: int = 12, rounds: int = 3, check_hom: bool = True, linked: bool = False, observed: bool = True):
        super().__init__(inducing, corr, power, steps, observed)
        self.rounds, self.check_hom, self.linked = rounds, check_hom, linked

    def fit(self, archive, space, target):
        base = self._prepared(archive, space, target)
        z = inducing_points(base, self.inducing)
        plain = base.withColumn("noise", F.lit(1.0))
        self.model, self.log_noise = fitted(plain, z, self.kernel, self.steps), None
        best, points, model = (self.model.bound, self.model, None), plain, self.model
        for k in range(self.rounds):
            seen = checkpointed(_noise_seen(points, model))
            middle = seen.agg(F.sum(F.col("sy")) / F.sum(F.col("n"))).first()[0]
            seen = seen.withColumn("syy", F.col("syy") - 2 * middle * F.col("sy") + middle * middle * F.col("n")).withColumn("sy", F.col("sy") - middle * F.col("n"))
            smooth = fitted(seen, z, self.kernel, self.steps, np.minimum(model.lengths, LONG / 2) if self.linked else SHORT)
            points = checkpointed(base.withColumn("noise", _noise_at(smooth)))
            model = fitted(points, z, self.kernel, self.steps if not k else max(2, self.steps // 3))
            if model.bound > best[0] or not self.check_hom:
                best = (model.bound, model, smooth)
        _, self.model, self.log_noise = best
        return self

    def _noise(self, x):
        level = self.model.s2 * self.model.g
        return np.full(len(x), level) if self.log_noise is None else level * _relative(self.log_noise.at(x)[0])


def _relative(log_noise: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(log_noise, -14, 14))


def _noise_at(smooth: Fitted) -> Column:
    @F.pandas_udf("double")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(_relative(smooth.at(np.stack(x.to_numpy()))[0])) if len(x) else pd.Series([], dtype=float)

    return at("x")


def _noise_seen(points: DataFrame, model: Fitted) -> DataFrame:
    """Design points (x, n, sy, syy, noise) whose one observation is the logarithm of the noise there, over the amount that all share; noise is the variance of that."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n, sy, syy, noise = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "sy", "syy", "noise"))
            mean, var = model.at(x)
            level = model.s2 * model.g
            pull = np.clip(var * n / (level * noise), 0, 0.95)
            within = np.maximum(syy - sy * sy / n, 0)
            square = (within + n * (sy / n - mean) ** 2 / (1 - pull)) / n
            told = np.log(np.maximum(square / level, 1e-9)) - (_digamma(n / 2) - np.log(n / 2))
            yield pa.RecordBatch.from_arrays([batch.column("x"), *(pa.array(v) for v in (np.ones(len(n)), told, told * told, _trigamma(n / 2)))], ["x", "n", "sy", "syy", "noise"])

    return points.select("x", "n", "sy", "syy", "noise").mapInArrow(run, "x array<double>, n double, sy double, syy double, noise double")


def _digamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x)), x.astype(float).copy()
    for _ in range(8):
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _trigamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x)), x.astype(float).copy()
    for _ in range(8):
        small = x < 8
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)
