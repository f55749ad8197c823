"""Typed parameter spaces and codomains: schemas with bounds, levels, conditional nulls and constraints."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpool.functions.frames import empty

_TYPES = {"dbl": T.DoubleType(), "int": T.LongType(), "fct": T.StringType(), "lgl": T.BooleanType(), "uty": T.StringType()}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class SpaceError(ValueError):
    """A table or definition doesn't fit a space."""


@dataclass(frozen=True)
class Param:
    id: str
    kind: str
    lower: float = -math.inf
    upper: float = math.inf
    levels: tuple[str, ...] = ()
    special: tuple = ()
    check: Callable[[Any], bool | str] | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("dbl", "int")

    @property
    def bounded(self) -> bool:
        return not self.numeric or math.isfinite(self.lower) and math.isfinite(self.upper)

    def accepts(self, kind: T.DataType) -> bool:
        """Whether a column of that type can hold the parameter: whole numbers may come as doubles, booleans only as booleans."""
        if self.kind == "lgl":
            return isinstance(kind, T.BooleanType)
        if self.kind == "fct":
            return isinstance(kind, T.StringType)
        return self.kind == "uty" or isinstance(kind, _NUMERIC)

    def valid(self, col: Column) -> Column:
        """Null, a special value, or within bounds or levels."""
        if self.kind == "dbl":
            ok = col.between(F.lit(self.lower), F.lit(self.upper)) & ~F.isnan(col.cast("double"))
        elif self.kind == "int":
            ok = col.between(F.lit(self.lower), F.lit(self.upper)) & (col.cast("double") == F.round(col.cast("double")))
        elif self.kind == "fct":
            ok = col.isin(list(self.levels))
        else:
            ok = F.lit(True)
        if self.special:
            ok = ok | col.isin(list(self.special))
        return col.isNull() | F.coalesce(ok, F.lit(False))

    def quantile(self, q: Column) -> Column:
        """The value at q of a uniform distribution over the parameter."""
        if self.kind == "dbl":
            return q * F.lit(float(self.upper - self.lower)) + F.lit(float(self.lower))
        if self.kind == "int":
            n = int(self.upper - self.lower) + 1
            return (F.least(F.floor(q * n), F.lit(n - 1)) + F.lit(int(self.lower))).cast("long")
        values = list(self.levels) if self.kind == "fct" else [True, False]
        return F.element_at(F.array(*map(F.lit, values)), (F.least(F.floor(q * len(values)), F.lit(len(values) - 1)) + 1).cast("int"))


def p_dbl(id: str, lower: float = -math.inf, upper: float = math.inf, special: tuple = ()) -> Param:
    return Param(id, "dbl", lower, upper, special=special)


def p_int(id: str, lower: float = -math.inf, upper: float = math.inf, special: tuple = ()) -> Param:
    return Param(id, "int", lower, upper, special=special)


def p_fct(id: str, levels, special: tuple = ()) -> Param:
    return Param(id, "fct", levels=tuple(levels), special=special)


def p_lgl(id: str, special: tuple = ()) -> Param:
    return Param(id, "lgl", special=special)


def p_uty(id: str, check: Callable[[Any], bool | str] | None = None) -> Param:
    return Param(id, "uty", check=check)


@dataclass(frozen=True)
class Needs:
    """child is active only where parent has one of the values."""

    child: str
    parent: str
    values: tuple

    def holds(self, parent: Column) -> Column:
        return F.coalesce(parent.isin(list(self.values)), F.lit(False))

    def __str__(self) -> str:
        shown = [str(v).upper() if isinstance(v, bool) else str(v) for v in self.values]
        return f"{self.parent} == {shown[0]}" if len(shown) == 1 else f"{self.parent} in {{{', '.join(shown)}}}"


@dataclass(frozen=True)
class Space:
    params: tuple[Param, ...]
    deps: tuple[Needs, ...] = ()
    fixed: Mapping[str, Any] = field(default_factory=dict)
    constraint: Callable[[DataFrame], Column] | None = None
    trafo: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        ids = self.ids
        if len(set(ids)) < len(ids):
            raise SpaceError("parameter ids must be unique")
        for d in self.deps:
            if d.child not in ids or d.parent not in ids:
                raise SpaceError(f"dependency on an unknown parameter: {d.child} on {d.parent}")
        for name in self.fixed:
            if name not in ids:
                raise SpaceError(f"a value for an unknown parameter: {name}")

    # --- structure

    @property
    def ids(self) -> list[str]:
        return [p.id for p in self.params]

    def __getitem__(self, id: str) -> Param:
        return next(p for p in self.params if p.id == id)

    def select(self, ids: list[str]) -> Space:
        return replace(self, params=tuple(self[i] for i in ids), deps=tuple(d for d in self.deps if d.child in ids and d.parent in ids), fixed={k: v for k, v in self.fixed.items() if k in ids})

    @property
    def finite(self) -> bool:
        return all(p.kind in ("fct", "lgl") or p.kind == "int" and p.bounded for p in self.params)

    def order(self) -> list[str]:
        """Ids with parents before children; a cycle is an error."""
        graph = {i: [d.parent for d in self.deps if d.child == i] for i in self.ids}
        try:
            return list(TopologicalSorter(graph).static_order())
        except CycleError as e:
            raise SpaceError(f"dependencies form a cycle: {e.args[1]}") from e

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(p.id, _TYPES[p.kind]) for p in self.params])

    def empty(self, spark: SparkSession) -> DataFrame:
        return empty(spark, self.struct_type())

    def active(self, id: str, at: Callable[[str], Column] = F.col) -> Column:
        """Whether a parameter's conditions all hold; a null parent is no match."""
        return reduce(lambda a, b: a & b, (d.holds(at(d.parent)) for d in self.deps if d.child == id), F.lit(True))

    # --- tables

    def project(self, df: DataFrame) -> DataFrame:
        """The features, in the space's order."""
        return df.select(*self.ids)

    def with_missing(self, df: DataFrame) -> DataFrame:
        """Absent parameters as typed nulls, parameters first and in order."""
        own = [F.col(p.id) if p.id in df.columns else F.lit(None).cast(_TYPES[p.kind]).alias(p.id) for p in self.params]
        return df.select(*own, *(c for c in df.columns if c not in self.ids))

    def cast(self, df: DataFrame) -> DataFrame:
        return df.withColumns({p.id: F.col(p.id).cast(_TYPES[p.kind]) for p in self.params if p.id in df.columns})

    def apply_design(self, df: DataFrame) -> DataFrame:
        """Fixed values put into whole columns, then inactive parameters nulled, parents first."""
        for name, value in self.fixed.items():
            df = df.withColumn(name, F.lit(value).cast(_TYPES[self[name].kind]))
        for i in self.order():
            if any(d.child == i for d in self.deps):
                df = df.withColumn(i, F.when(self.active(i), F.col(i)))
        return df

    def valid(self, df: DataFrame) -> Column:
        """Row-wise admissibility without raising; columns of a wrong type admit nothing. The constraint comes last."""
        if not all(p.accepts(df.schema[p.id].dataType) for p in self.params):
            return F.lit(False)
        ok = reduce(lambda a, b: a & b, (p.valid(F.col(p.id)) for p in self.params), F.lit(True))
        for i in {d.child for d in self.deps}:
            ok = ok & (F.col(i).isNull() | self.active(i))
        if self.constraint is not None:
            ok = F.when(ok, F.coalesce(self.constraint(df), F.lit(False))).otherwise(False)
        return ok

    def pool_candidates(self, pool: DataFrame) -> DataFrame:
        """Rows that the design leaves as they are and that are admissible."""
        changed = self.apply_design(pool.withColumns({f"{i}__was": F.col(i) for i in self.ids}))
        stays = reduce(lambda a, b: a & b, (F.col(i).eqNullSafe(F.col(f"{i}__was")) for i in self.ids))
        changed = changed.where(stays).drop(*(f"{i}__was" for i in self.ids))
        return changed.where(self.valid(changed))

    def assert_table(self, df: DataFrame, unique: bool = True, min_rows: int = 1, subset: bool = False, extra: bool = True, untyped: bool = True) -> DataFrame:
        """The table cast to the space, or SpaceError: names, types, one pass that counts each kind of violation, uniqueness."""
        missing = [i for i in self.ids if i not in df.columns]
        if missing and not subset:
            raise SpaceError(f"missing columns: {', '.join(missing)}")
        more = [c for c in df.columns if c not in self.ids]
        if more and not extra:
            raise SpaceError(f"extra columns: {', '.join(more)}")
        if not untyped and any(p.kind == "uty" for p in self.params):
            raise SpaceError("untyped parameters are not allowed here")
        for p in self.params:
            if p.id in df.columns and not p.accepts(df.schema[p.id].dataType):
                raise SpaceError(f"column {p.id} is {df.schema[p.id].dataType.simpleString()}, not {p.kind}")
        df = self.with_missing(df)
        checks = {p.id: F.count_if(~p.valid(F.col(p.id))) for p in self.params}
        checks |= {f"dependency {k}": F.count_if(F.col(d.child).isNotNull() & ~d.holds(F.col(d.parent))) for k, d in enumerate(self.deps)}
        got = df.agg(F.count("*").alias("rows"), *(c.alias(k) for k, c in checks.items())).first().asDict()
        if got["rows"] < min_rows:
            raise SpaceError(f"at least {min_rows} rows are needed")
        for p in self.params:
            if got[p.id]:
                raise SpaceError(f"{got[p.id]} rows have a value of {p.id} outside its bounds or levels")
        for k, d in enumerate(self.deps):
            if got[f"dependency {k}"]:
                raise SpaceError(f"{d.child} has a value although dependency '{d}' does not hold")
        for p in self.params:
            if p.check is not None:
                for row in df.select(p.id).where(F.col(p.id).isNotNull()).toLocalIterator():
                    if (said := p.check(row[0])) is not True:
                        raise SpaceError(f"{p.id}: {said or 'check failed'}")
        df = self.cast(df)
        if self.constraint is not None and not df.where(~F.coalesce(self.constraint(df), F.lit(False))).isEmpty():
            raise SpaceError("a row breaks the constraint")
        if unique:
            self.assert_unique(df)
        return df

    def assert_unique(self, df: DataFrame) -> None:
        if not df.groupBy(*self.ids).count().where("count > 1").isEmpty():
            raise SpaceError("duplicate configurations")

    def volume(self) -> float:
        """Product of ranges, numbers of levels, and 2 for booleans; infinite ranges are an error."""
        out = 1.0
        for p in self.params:
            if not p.bounded or p.kind == "uty":
                raise SpaceError(f"{p.id} has no finite volume")
            out *= p.upper - p.lower if p.numeric else len(p.levels) if p.kind == "fct" else 2
        return out


GOALS = ("minimize", "maximize", "learn")


@dataclass(frozen=True)
class Codomain:
    """Output columns; tags say which are targets and what is wanted of them. Columns without a tag come along."""

    tags: Mapping[str, str | None]

    def __post_init__(self):
        if not self.targets:
            raise SpaceError("a codomain needs a column with a tag")
        if any(t is not None and t not in GOALS for t in self.tags.values()):
            raise SpaceError(f"tags are {', '.join(GOALS)}")

    @property
    def ids(self) -> list[str]:
        return list(self.tags)

    @property
    def targets(self) -> list[str]:
        return [c for c, t in self.tags.items() if t]

    @property
    def goals(self) -> list[str]:
        return [g for g in GOALS if g in self.tags.values()]

    def sign(self) -> int:
        """What to multiply a score by so that more is better; for one target only."""
        if len(self.targets) != 1:
            raise SpaceError("one target is needed")
        return -1 if self.tags[self.targets[0]] == "minimize" else 1


def assert_pool_space(space: Space) -> None:
    """Pools have a domain, and none that is transformed or untyped."""
    if not space.params:
        raise SpaceError("a domain needs a parameter")
    if space.trafo is not None:
        raise SpaceError("a pool's domain can't have a transformation")
    if any(p.kind == "uty" for p in space.params):
        raise SpaceError("a pool's domain can't have untyped parameters")
