"""Spaces that a table spans, and how its rows fill the grid of a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpool.functions.frames import usable
from siftpool.operators.design import GRID_LIMIT, _resolutions, axis, grid
from siftpool.space import _NUMERIC, Needs, Param, Space, SpaceError, p_dbl, p_fct, p_int, p_lgl

LEVELS = 10_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spanned(df: DataFrame, ids: list[str], deps: tuple[Needs, ...] = (), levels: int = LEVELS) -> Space:
    """The space that the rows of df span: bounds of all numbers in one aggregation, levels of texts in their order.

    Nulls and NaN count for nothing. A number without a value, a text without
    one, and a text with more than so many levels are errors.
    """
    kinds = {i: df.schema[i].dataType for i in ids}
    numbers = [i for i in ids if isinstance(kinds[i], _NUMERIC)]
    value = {i: F.col(i) if isinstance(kinds[i], _WHOLE) else usable(F.col(i)) for i in numbers}
    ends = df.agg(F.lit(1), *(f(value[i]).alias(f"{f.__name__}_{i}") for i in numbers for f in (F.min, F.max))).first()
    params: list[Param] = []
    for i in ids:
        if i in numbers:
            lower, upper = ends[f"min_{i}"], ends[f"max_{i}"]
            if lower is None:
                raise SpaceError(f"{i} has no value that could bound it")
            params.append((p_int if isinstance(kinds[i], _WHOLE) else p_dbl)(i, lower, upper))
        elif isinstance(kinds[i], T.BooleanType):
            params.append(p_lgl(i))
        elif isinstance(kinds[i], T.StringType):
            found = sorted(r[0] for r in df.select(i).where(F.col(i).isNotNull()).distinct().limit(levels + 1).collect())  # a checked bound
            if not found or len(found) > levels:
                raise SpaceError(f"{i} has {'no' if not found else f'more than {levels}'} levels")
            params.append(p_fct(i, found))
        else:
            raise SpaceError(f"{i} is {kinds[i].simpleString()}, which no parameter holds")
    return Space(tuple(params), tuple(deps))


def nearest_on_axis(x: Column, values: list) -> Column:
    """The value nearest to x of an ascending axis of numbers, the lower of two as near; null and NaN stay null."""
    if len(values) == 1:
        return F.when(usable(x).isNotNull(), F.lit(values[0]))
    middles = F.array(*(F.lit((a + b) / 2) for a, b in zip(values, values[1:])))
    return F.when(usable(x).isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.size(F.filter(middles, lambda m: m < x)) + 1))


def occupancy(df: DataFrame, space: Space, resolution: int | None = None, each: dict[str, int] | None = None, limit: float = GRID_LIMIT) -> DataFrame:
    """The grid of a space with n_rows, the number of rows of df at each point; 0 where there is none.

    A row counts at the nearest value of each axis, once fixed values and
    conditions are applied. Rows with an active parameter that is null or has
    an unknown level are at no point. Rows are counted before they meet the
    grid, so that what is shuffled is a count for each point and task.
    """
    res = _resolutions(space, resolution, each)
    own = space.apply_design(space.cast(space.project(df)))
    at = {p.id: nearest_on_axis(F.col(p.id), axis(space, p.id, res[p.id])) if p.numeric else F.col(p.id) for p in space.params}
    counts = own.select(*(c.alias(f"{i}__at") for i, c in at.items())).groupBy(*(f"{i}__at" for i in at)).agg(F.count("*").alias("n_rows"))
    points = grid(df.sparkSession, space, resolution, each, limit)
    met = None
    for i in space.ids:
        here = points[i].eqNullSafe(counts[f"{i}__at"])
        met = here if met is None else met & here
    return points.join(counts, met, "left").select(*space.ids, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
