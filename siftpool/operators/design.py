"""Designs over a space: grids that respect dependencies, random, Latin hypercube and Sobol points."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count, islice
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.space import _TYPES, Param, Space, SpaceError

GRID_LIMIT = 10_000_000


def axis(space: Space, id: str, resolution: int) -> list:
    """A parameter's distinct grid values: quantiles of an even sequence, all levels, or the one fixed value."""
    p: Param = space[id]
    if id in space.fixed:
        return [space.fixed[id]]
    if p.kind == "fct":
        return list(p.levels)
    if p.kind == "lgl":
        return [True, False]
    if p.kind == "uty" or not p.bounded:
        raise SpaceError(f"{id} has no finite grid")
    at = [i / (resolution - 1) for i in range(resolution)] if resolution > 1 else [0.0]
    if p.kind == "dbl":
        return sorted({p.lower + q * (p.upper - p.lower) for q in at})
    n = int(p.upper - p.lower) + 1
    return sorted({int(p.lower) + min(int(q * n), n - 1) for q in at})


def _resolutions(space: Space, resolution: int | None, each: dict[str, int] | None) -> dict[str, int]:
    each = dict(each or {})
    for i in each:
        if i not in space.ids:
            raise SpaceError(f"a resolution for an unknown parameter: {i}")
    need = [p.id for p in space.params if p.numeric and p.id not in each and p.id not in space.fixed]
    if need and resolution is None:
        raise SpaceError(f"resolutions are missing: {', '.join(need)}")
    if any(r < 1 for r in [*each.values(), *([resolution] if resolution is not None else [])]):
        raise SpaceError("resolutions are 1 at least")
    return {i: each.get(i, resolution or 1) for i in space.ids}


def grid_size(space: Space, resolution: int | None = None, each: dict[str, int] | None = None, limit: float = math.inf) -> int:
    """Rows of grid(), counted without making them: parents first, keeping only values that later parameters depend on. Stops beyond limit."""
    res = _resolutions(space, resolution, each)
    order = space.order()
    states: Counter = Counter({(): 1})
    names: list[str] = []
    for k, i in enumerate(order):
        later = {d.parent for d in space.deps if d.child in order[k + 1 :]}
        own = [d for d in space.deps if d.child == i]
        values = axis(space, i, res[i])
        names2 = [n for n in [*names, i] if n in later]
        new: Counter = Counter()
        for state, n in states.items():
            at = dict(zip(names, state))
            for v in values if all(at.get(d.parent) in d.values for d in own) else [None]:
                full = at | {i: v}
                new[tuple(full[x] for x in names2)] += n
        states, names = new, names2
        if sum(states.values()) > limit:
            break
    return sum(states.values())


def grid(spark: SparkSession, space: Space, resolution: int | None = None, each: dict[str, int] | None = None, limit: float = GRID_LIMIT) -> DataFrame:
    """All combinations of grid values; inactive parameters are null, and their rows are not repeated. Too large a grid is an error before any row is made."""
    res = _resolutions(space, resolution, each)
    if grid_size(space, resolution, each, limit) > limit:
        raise SpaceError(f"the grid has more rows than upper_limit ({limit:g})")
    df = spark.range(1)
    for i in space.order():
        kind = _TYPES[space[i].kind]
        values = F.array(*(F.lit(v).cast(kind) for v in axis(space, i, res[i])))
        active = space.active(i) if any(d.child == i for d in space.deps) else None
        df = df.withColumn(i, F.explode(values if active is None else F.when(active, values).otherwise(F.array(F.lit(None).cast(kind)))))
    return df.select(*space.ids)


def _uniform(name: str, *salt) -> Column:
    """A number from 0 to 1 (excluded) by a hash."""
    return F.pmod(F.xxhash64(name, *map(F.lit, salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def random_design(spark: SparkSession, space: Space, n: int, seed: int = 1) -> DataFrame:
    """n independent uniform points."""
    df = spark.range(n)
    return space.apply_design(df.select(*(p.quantile(_uniform("id", seed, k)).alias(p.id) for k, p in enumerate(space.params))))


def _dealt(n: int, seed: int, k: int):
    """The slot of each row number: a permutation of 0 to n - 1 keyed by seed and k, by Feistel rounds over the next power of four, repeated while a number is n or more."""
    half = max(1, (max(n - 1, 0).bit_length() + 1) // 2)
    keys = np.random.default_rng([seed & (1 << 63) - 1, k]).integers(0, 1 << 63, 6).astype(np.uint64)

    def rounds(x):
        left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
        for key in keys:
            h = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (h >> np.uint64(64 - half))
        return left << np.uint64(half) | right

    def slot(ids: pd.Series) -> pd.Series:
        x = rounds(ids.to_numpy().astype(np.uint64))
        while (far := x >= np.uint64(n)).any():
            x[far] = rounds(x[far])
        return pd.Series(x.astype(np.int64))

    return F.pandas_udf(slot, "long")


def lhs_design(spark: SparkSession, space: Space, n: int, seed: int = 1) -> DataFrame:
    """A Latin hypercube: each of n equal slices of each parameter holds one point. Each parameter's slices are dealt by a permutation of its own, computed from the row number, so no order over all rows is needed."""
    df = spark.range(n)
    cols = []
    for k, p in enumerate(space.params):
        cols.append(p.quantile((_dealt(n, seed, k)("id") + _uniform("id", seed, k)) / F.lit(float(max(n, 1)))).alias(p.id))
    return space.apply_design(df.select(*cols))


#: First direction numbers of the Sobol sequence, from the second dimension on.
SOBOL = [
    (1,),
    (1, 3),
    (1, 3, 1),
    (1, 1, 1),
    (1, 1, 3, 3),
    (1, 3, 5, 13),
    (1, 1, 5, 5, 17),
    (1, 1, 5, 5, 5),
    (1, 1, 7, 11, 19),
]
_BITS = 32


def _primitive(degree: int, poly: int) -> bool:
    """Whether x has order 2^degree - 1 modulo the polynomial of these bits."""
    x, order = 1, (1 << degree) - 1
    for step in range(1, order + 1):
        x <<= 1
        if x >> degree:
            x ^= poly
        if x == 1:
            return step == order
    return False


def _polynomials() -> Iterator[tuple[int, int]]:
    """Degree and inner coefficients of all primitive polynomials, by degree and value."""
    for degree in count(1):
        yield from ((degree, a) for a in range(1 << degree - 1) if _primitive(degree, 1 << degree | a << 1 | 1))


def _directions(dims: int) -> list[list[int]]:
    """Direction numbers of each dimension. Beyond the fixed ones the first numbers are odd by a seeded draw, which any Sobol sequence allows."""
    out = [[1 << (_BITS - 1 - i) for i in range(_BITS)]]
    for dim, (s, a) in enumerate(islice(_polynomials(), max(0, dims - 1))):
        draw = Random(dim)
        m = SOBOL[dim] if dim < len(SOBOL) else [2 * draw.randrange(1 << i) + 1 for i in range(s)]
        v = [m[i] << (_BITS - 1 - i) for i in range(s)]
        for i in range(s, _BITS):
            x = v[i - s] ^ (v[i - s] >> s)
            for k in range(1, s):
                x ^= ((a >> (s - 1 - k)) & 1) * v[i - k]
            v.append(x)
        out.append(v)
    return out[:dims]


def sobol_design(spark: SparkSession, space: Space, n: int, skip: int = 1) -> DataFrame:
    """Points skip to skip + n - 1 of the Sobol sequence, each from the bits of its own number."""
    df = spark.range(skip, skip + n)
    cols = []
    for p, directions in zip(space.params, _directions(len(space.params))):
        x = F.lit(0).cast("long")
        for bit, v in enumerate(directions[: max(1, (skip + n).bit_length())]):
            x = x.bitwiseXOR(F.shiftright("id", bit).bitwiseAND(F.lit(1)) * F.lit(v))
        cols.append(p.quantile(x / F.lit(float(1 << _BITS))).alias(p.id))
    return space.apply_design(df.select(*cols))
