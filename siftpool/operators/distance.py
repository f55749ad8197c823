"""Distances between rows of a pool and reference rows, as expressions over arrays of references."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import arrays, beside, block, by_key, checkpointed, few, over_block
from siftpool.operators.nearest import Euclidean, Mixed, nearest, over_all, tasks
from siftpool.space import Space

NEAR = 4096  # references that are compared with all rows at most where the nearest is asked; more are met by balls
PAIRS = 1 << 24  # pairs of a task, about, where all are asked
BLOCK = 512  # rows of a block there


class DistanceError(ValueError):
    """A distance is used before it is ready, or on a space it can't handle."""


class Distance:
    """fit() on a pool or a space's bounds, set_references(), then pairs() or fold().

    Fitted statistics are one row, kept as numbers; references stay a DataFrame
    that is sent to the tasks in arrays of bounded size.
    """

    key, label, geometric = "", "", False

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.space: Space | None = None
        self.references: DataFrame | None = None
        self._carried: list[str] = []

    def fit(self, pool: DataFrame | None, space: Space) -> Distance:
        self.clear()
        self._check(space)
        self._fit(None if pool is None else space.project(pool), space)
        self.space = space
        return self

    def set_references(self, rows: DataFrame, carry: tuple[str, ...] = ()) -> Distance:
        """Reference rows; carry names further columns that fold() can use."""
        if self.space is None:
            raise DistanceError(f"distance '{self.key}' is not fitted")
        self.references, self._carried = rows.select(*self.space.ids, *carry), list(carry)
        return self

    def _ready(self) -> None:
        if self.space is None:
            raise DistanceError(f"distance '{self.key}' is not fitted")
        if self.references is None:
            raise DistanceError(f"distance '{self.key}' has no reference points")

    def fold(self, rows: DataFrame, out: str, of: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
        """rows with a column of(refs), refs being the array of all references; join() puts two arrays' results together."""
        self._ready()
        for k, refs in enumerate(arrays(self.references, [*self.space.ids, *self._carried])):
            rows = beside(rows, refs)
            new = of(F.col("refs"))
            rows = rows.withColumn(out, join(F.col(out), new) if k else new).drop("refs")
        return rows

    def nearest(self, rows: DataFrame, out: str = "distance") -> DataFrame:
        """Distance to the nearest reference."""
        return self.fold(rows, out, lambda refs: F.array_min(F.transform(refs, self.between)), F.least)

    def coordinates(self) -> list[Column]:
        """A row as a point, as doubles (an embedding's NaN counts as 0)."""
        raise NotImplementedError

    def stored(self) -> list[Column]:
        """What kernel() takes of a row, as doubles."""
        return self.coordinates()

    def kernel(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Distances of rows' stored() values and references' in arrays; squared ones if the distance is geometric."""
        raise NotImplementedError

    def parts(self) -> list[float | None]:
        """For each of stored() the scale of its differences, None where values only match or differ; 0 leaves it out."""
        raise NotImplementedError

    def between_boxes(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Bounds of the distances from boxes (least and largest stored() values of their points, which agree in what only matches and in what is null) to rows."""
        scales, geometric = self.parts(), self.geometric

        def bounds(lo: np.ndarray, hi: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, high, known = (np.zeros((len(lo), len(rows))) for _ in range(3))
            for k, s in enumerate(scales):
                if s is not None and s <= 0:
                    continue
                a, b, x = lo[:, k, None], hi[:, k, None], rows[None, :, k]
                if s is None:
                    near = far = (a != x).astype(float)
                else:
                    near, far = np.maximum(np.maximum(a - x, x - b), 0) / s, np.maximum(x - a, b - x) / s
                if geometric:
                    low += near * near
                    high += far * far
                    continue
                both = ~np.isnan(a) & ~np.isnan(x)
                low += np.where(both, near, 0.0)
                high += np.where(both, far, 0.0)
                known += both
            if geometric:
                return np.sqrt(low), np.sqrt(high)
            return low / np.maximum(known, 1), high / np.maximum(known, 1)

        return bounds

    def over_references(self, rows: DataFrame, out: str, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str], extra: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
        """rows with a struct out: kernel(distances of rows and a block of references, squared if geometric, the rows' extra columns, the references' carried columns), blocks put together by join(); null without references.

        Few references are sent to all tasks; more meet the rows in blocks. With
        counted, equal references are one, with their number as a last carried
        column, and equal rows are met once.
        """
        self._ready()
        at_rows, apart = self.stored(), self.kernel()
        n, own = len(at_rows), [*at_rows, *(F.col(c) for c in extra)]

        def at(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
            return kernel(apart(x[:, :n], refs[:, :n]), x[:, n:], refs[:, n:])

        told = [*at_rows, *map(F.col, self._carried)]
        references, order = self.references, by_key([*self.space.ids, *self._carried])
        if counted:
            keys = [f"ref{i}__" for i in range(len(told))]
            references = references.select(*(c.cast("double").alias(k) for c, k in zip(told, keys))).groupBy(*keys).agg(F.count("*").cast("double").alias("n__"))
            told, order = [F.col(c) for c in (*keys, "n__")], by_key(keys)
        if counted and not few(references, NEAR):
            keys = [f"own{i}__" for i in range(len(own))]
            rows = checkpointed(rows.withColumns({k: c.cast("double") for c, k in zip(own, keys)}))
            met = rows.select(*keys).distinct().toDF(*(f"{k}m" for k in keys))
            met = over_all(met, [F.col(c) for c in met.columns], references, told, at, join, names, out)
            return rows.join(met, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}m")) for k in keys))).drop(*keys, *(f"{k}m" for k in keys))
        if not few(references):
            return over_all(rows, own, references, told, at, join, names, out)
        refs = block(references, told, order)
        if not len(refs):
            return rows.withColumn(out, F.lit(None).cast(f"struct<{', '.join(f'{c}: double' for c in names)}>"))
        if len(names) == 1:  # a struct of one double would come back as a series
            one = over_block(refs, lambda x, y: at(x, y).reshape(-1), own, rows.sparkSession)
            return rows.withColumn(out, F.struct(one.alias(names[0])))
        return rows.withColumn(out, over_block(refs, at, own, rows.sparkSession, ", ".join(f"{c} double" for c in names)))

    def pairs(self, rows: DataFrame, ids: dict[str, str], out: str = "distance", of: Callable[[Column], Column] = lambda d: d) -> DataFrame:
        """All pairs of a row and a reference with of(distance); ids maps carried columns of the references to their names in the result.

        Blocks of rows meet blocks of references, and equal values meet once. The
        pairs of equal values lie together and the ids of a block come again and
        again, so that files of the result hold runs and repeats in place of each.
        """
        self._ready()
        met = self._blocks(rows, "own__").crossJoin(self._blocks(self.references, "refs__").hint("shuffle_replicate_nl"))
        met = met.select("own__", F.explode("refs__").alias("ref__")).select(F.explode("own__").alias("own__"), "ref__")
        met = met.select("own__.at.*", F.col("own__.rows").alias("rows__"), "ref__").withColumn("told__", self.between(F.col("ref__.at")))
        met = met.select("rows__", F.col("ref__.rows").alias("refs__"), of(F.col("told__")).alias("told__"))
        met = met.select(F.explode("rows__").alias("row__"), "refs__", "told__").select("row__", F.explode("refs__").alias("ref__"), "told__")
        return met.select(*(F.col("row__").getField(c).alias(c) for c in rows.columns), *(F.col("ref__").getField(c).alias(n) for c, n in ids.items()), F.col("told__").alias(out))

    def _blocks(self, rows: DataFrame, out: str) -> DataFrame:
        """rows sorted by their values and cut into blocks of BLOCK at most: an array of a block's values at, each with an array of its rows. Two partitions of such frames have PAIRS pairs, about."""
        n, at, kinds = rows.count(), self.space.ids, dict(rows.dtypes)
        parts = max(1, min(n, max(-(-n // math.isqrt(PAIRS)), math.isqrt(tasks(rows) - 1) + 1)))  # a small table is one partition, its pairs would be one task
        order = by_key([*at, *(c for c in rows.columns if c not in at and "map<" not in kinds[c])])
        placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("block__", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
        met = placed.repartitionByRange(parts, "block__").groupBy("block__", F.struct(*at).alias("at")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        met = met.groupBy("block__").agg(F.collect_list(F.struct("at", "rows")).alias(out)).select(out)
        return checkpointed(met.coalesce(parts))  # each meets all others, so there are no more, whatever a shuffle has

    def to(self, values: dict) -> Column:
        """Distance of a row to one point given as values."""
        return self.between({i: F.lit(values[i]).cast(self.space.struct_type()[i].dataType) for i in self.space.ids})

    def between(self, ref) -> Column:
        """Distance of a row's columns to a reference (a struct, or a mapping of columns)."""
        raise NotImplementedError

    def _check(self, space: Space) -> None:
        pass

    def _fit(self, pool: DataFrame | None, space: Space) -> None:
        pass


class Geometry(Distance):
    """Euclidean distance between embeddings; null and constant coordinates are 0."""

    geometric = True

    def axes(self, at: Callable[[str], Column] = F.col) -> list[tuple[Column, float, float]]:
        """For each coordinate a row's value, the centre and the scale; a scale of 0 leaves the coordinate out."""
        raise NotImplementedError

    def embedding(self, at: Callable[[str], Column] = F.col) -> list[Column]:
        return [F.coalesce((v - F.lit(m)) / F.lit(s), F.lit(0.0)) if s > 0 else F.lit(0.0) for v, m, s in self.axes(at)]

    def stored(self):
        """The values themselves, as their differences are exact where those of an embedding are rounded."""
        return [F.coalesce(F.nanvl(v, F.lit(m)), F.lit(m)) if s > 0 else F.lit(0.0) for v, m, s in self.axes()]

    def parts(self):
        return [s for _, _, s in self.axes()]

    def scales(self) -> list[float]:
        return [s if s > 0 else 1.0 for _, _, s in self.axes()]

    @property
    def dimension(self) -> int:
        return len(self.embedding())

    def embedded(self, rows: DataFrame, out: str = "embedding") -> DataFrame:
        return rows.withColumn(out, F.array(*self.embedding()))

    def coordinates(self):
        return [F.nanvl(c.cast("double"), F.lit(0.0)) for c in self.embedding()]

    def kernel(self):
        scales = self.scales()

        def summed(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x), len(refs)))
            for k, s in enumerate(scales):
                apart = (x[:, k, None] - refs[None, :, k]) / s
                total += apart * apart
            return total

        return summed

    def neighbours(self, rows: DataFrame, k: int, out: str = "near", carry: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
        """rows with the k nearest references as in nearest.nearest(); carry are carried columns."""
        self._ready()
        return nearest(rows, self.stored(), self.references, self.stored(), k, carry, ordered, out, Euclidean(self.scales()))

    def nearest(self, rows, out="distance"):
        self._ready()
        if few(self.references, NEAR):
            own = self.over_references(rows, "least__", lambda d2, *_: np.sqrt(d2.min(axis=1)), np.minimum, ["d"])
            return own.withColumn(out, F.col("least__.d")).drop("least__")
        return self.neighbours(rows, 1, "least__").withColumn(out, F.col("least__")[0]["d"]).drop("least__")

    def squared(self, ref) -> Column:
        parts = []
        for (a, m, s), (b, _, _) in zip(self.axes(), self.axes(lambda c: ref[c])):
            one = (F.coalesce(a, F.lit(m)) - F.coalesce(b, F.lit(m))) / F.lit(s) if s > 0 else F.lit(0.0)
            parts.append(one * one)
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def between(self, ref) -> Column:
        return F.sqrt(self.squared(ref))


class Affine(Geometry):
    """Numeric columns put to [-1, 1] by the pool's minimum and maximum, or the space's bounds."""

    key, label = "affine", "Affine scaling to [-1, 1], Euclidean"

    def _check(self, space: Space) -> None:
        if not all(p.numeric for p in space.params):
            raise DistanceError("distance 'affine' needs numeric parameters")
        if space.deps:
            raise DistanceError("distance 'affine' can't handle dependencies")

    def _fit(self, pool, space) -> None:
        if pool is None:
            if not all(p.bounded for p in space.params):
                raise DistanceError("distance 'affine' needs finite bounds without a pool")
            self.range = {p.id: (float(p.lower), float(p.upper)) for p in space.params}
            return
        row = pool.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in space.ids for n, f in (("lo", F.min), ("hi", F.max)))).first()
        self.range = {c: (row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] or 0.0) for c in space.ids}

    def axes(self, at=F.col):
        return [(at(c).cast("double"), (lo + hi) / 2, (hi - lo) / 2) for c, (lo, hi) in self.range.items()]


class Standardize(Geometry):
    """Numeric columns and one dummy for each declared level, centred and divided by their standard deviation."""

    key, label = "standardize", "z-scores with one-hot levels, Euclidean"

    @staticmethod
    def _terms(space: Space) -> list[tuple[str, object]]:
        """(column, None) for numbers, (column, level) for dummies."""
        out = []
        for p in space.params:
            if p.kind == "uty":
                raise DistanceError("distance 'standardize' can't handle untyped parameters")
            out += [(p.id, None)] if p.numeric else [(p.id, v) for v in (p.levels if p.kind == "fct" else (False, True))]
        return out

    @staticmethod
    def _value(at, c, level) -> Column:
        return at(c).cast("double") if level is None else F.when(at(c).isNotNull(), (at(c) == F.lit(level)).cast("double"))

    def _fit(self, pool, space) -> None:
        terms = self._terms(space)
        if pool is None:
            self.stats = [(c, v, *self._bounds(space[c])) for c, v in terms]
            return
        row = pool.agg(*(f(self._value(F.col, c, v)).alias(f"{n}{k}") for k, (c, v) in enumerate(terms) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        self.stats = [(c, v, row[f"m{k}"] or 0.0, row[f"s{k}"] or 0.0) for k, (c, v) in enumerate(terms)]

    @staticmethod
    def _bounds(p) -> tuple[float, float]:
        """Mean and deviation of a uniform distribution over the parameter."""
        if not p.bounded:
            raise DistanceError("distance 'standardize' needs finite bounds without a pool")
        if p.kind == "dbl":
            return (p.lower + p.upper) / 2, (p.upper - p.lower) / math.sqrt(12)
        if p.kind == "int":
            return (p.lower + p.upper) / 2, math.sqrt(((p.upper - p.lower + 1) ** 2 - 1) / 12)
        share = 1 / (len(p.levels) if p.kind == "fct" else 2)
        return share, math.sqrt(share * (1 - share))

    def axes(self, at=F.col):
        return [(self._value(at, c, v), m, s) for c, v, m, s in self.stats]


class Gower(Distance):
    """Mean over columns known on both sides of scaled absolute differences and mismatches; 0 where no column is.

    scale: minmax_auto (the pool's range, else the bounds), minmax_space,
    minmax_empirical, standardize (the pool's deviation) or off. Numeric columns
    without spread are left out.
    """

    key, label = "gower", "Gower, mixed columns"
    MODES = ("minmax_auto", "minmax_space", "minmax_empirical", "standardize", "off")

    def __init__(self, scale: str = "minmax_auto"):
        if scale not in self.MODES:
            raise DistanceError(f"scale is one of {', '.join(self.MODES)}")
        self.scale = scale
        super().__init__()

    def _fit(self, pool, space) -> None:
        numbers = [p for p in space.params if p.numeric]
        mode = self.scale
        if mode == "minmax_auto":
            mode = "minmax_space" if pool is None else "minmax_empirical"
        if pool is None and mode in ("minmax_empirical", "standardize"):
            raise DistanceError(f"distance 'gower' with scale '{mode}' needs a pool")
        if mode == "off":
            self.spread = {p.id: 1.0 for p in numbers}
        elif mode == "minmax_space":
            if not all(p.bounded for p in numbers):
                raise DistanceError("distance 'gower' needs finite bounds")
            self.spread = {p.id: float(p.upper - p.lower) for p in numbers}
        else:
            of = (lambda c: F.stddev_samp(c)) if mode == "standardize" else (lambda c: F.max(c) - F.min(c))
            row = pool.agg(F.lit(0).alias("none"), *(of(p.id).cast("double").alias(p.id) for p in numbers)).first()
            self.spread = {p.id: row[p.id] or 0.0 for p in numbers}

    def coordinates(self):
        out = []
        for p in self.space.params:
            if p.numeric:
                out.append(F.col(p.id).cast("double"))
                continue
            code = F.pmod(F.xxhash64(p.id), F.lit(1 << 50)) + 1000  # of what is not a declared level
            if p.kind == "fct":
                place = F.array_position(F.array(*(F.lit(v) for v in p.levels)), F.col(p.id))
                code = F.when(place > 0, place).otherwise(code)
            out.append(F.when(F.col(p.id).isNotNull(), code).cast("double"))
        return out

    def parts(self):
        return [self.spread[p.id] if p.numeric else None for p in self.space.params]

    def kernel(self):
        spreads = [self.spread[p.id] if p.numeric else None for p in self.space.params]

        def apart(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
            total, known = np.zeros((len(x), len(refs))), np.zeros((len(x), len(refs)))
            for k, spread in enumerate(spreads):
                if spread is not None and spread <= 0:
                    continue
                a, b = x[:, k, None], refs[None, :, k]
                both = ~np.isnan(a) & ~np.isnan(b)
                total += np.where(both, a != b if spread is None else np.abs(a - b) / spread, 0.0)
                known += both
            return np.where(known > 0, total / np.maximum(known, 1), 0.0)

        return apart

    def nearest(self, rows, out="distance"):
        self._ready()
        if few(self.references, NEAR):
            own = self.over_references(rows, "least__", lambda d, *_: d.min(axis=1), np.minimum, ["d"])
            return own.withColumn(out, F.col("least__.d")).drop("least__")
        return self._by_balls(rows, out)

    def _by_balls(self, rows: DataFrame, out: str) -> DataFrame:
        """The same by the triangle inequality, which holds among rows that know the same columns: those that know others are met apart."""
        used = [(c, self.spread[p.id] if p.numeric else None) for p, c in zip(self.space.params, self.coordinates()) if not (p.numeric and self.spread[p.id] <= 0)]
        if not used:
            return rows.withColumn(out, F.lit(0.0))
        known = sum((F.when(F.nanvl(c, F.lit(None).cast("double")).isNotNull(), 1 << k).otherwise(0) for k, (c, _) in enumerate(used)), F.lit(0))
        rows, refs = checkpointed(rows.withColumn("known__", known)), checkpointed(self.references.withColumn("known__", known))
        patterns = [sorted(r.known__ for r in f.select("known__").distinct().collect()) for f in (rows, refs)]
        told = None
        for p in patterns[0]:
            mine = rows.where(F.col("known__") == p).withColumn(out, F.lit(None).cast("double"))
            for both in sorted({p & q for q in patterns[1]}):
                cols = [u for k, u in enumerate(used) if both >> k & 1]
                if not cols:  # nothing in common is a distance of 0
                    mine = mine.withColumn(out, F.lit(0.0))
                    continue
                at, others = [c for c, _ in cols], refs.where(F.col("known__").bitwiseAND(p) == both)
                near = nearest(mine, at, others, at, 1, (), False, "least__", Mixed([s for _, s in cols]))
                mine = near.withColumn(out, F.least(out, F.col("least__")[0]["d"])).drop("least__")
            told = mine if told is None else told.unionByName(mine)
        return (rows.withColumn(out, F.lit(None).cast("double")) if told is None else told).drop("known__")

    def between(self, ref):
        parts, known = [], []
        for p in self.space.params:
            a, b = F.col(p.id), ref[p.id]
            if p.numeric and self.spread[p.id] <= 0:
                continue
            both = a.isNotNull() & b.isNotNull()
            one = F.abs(a.cast("double") - b.cast("double")) / F.lit(self.spread[p.id]) if p.numeric else (a != b).cast("double")
            parts.append(F.when(both, one).otherwise(0.0))
            known.append(both.cast("double"))
        if not parts:
            return F.lit(0.0)
        total, n = parts[0], known[0]
        for x, k in zip(parts[1:], known[1:]):
            total, n = total + x, n + k
        return F.when(n > 0, total / n).otherwise(0.0)


DISTANCES: dict[str, Callable[..., Distance]] = {c.key: c for c in (Affine, Gower, Standardize)}


def distance(key: str, **args) -> Distance:
    if key not in DISTANCES:
        raise DistanceError(f"no distance '{key}'; there are {', '.join(sorted(DISTANCES))}")
    return DISTANCES[key](**args)


def distances(keys: list[str]) -> Iterator[Distance]:
    return (distance(k) for k in keys)
