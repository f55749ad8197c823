"""What is searched: tables with known outputs, functions over pools, fitted models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.operators.surrogates import Surrogate
from siftpool.space import Codomain, Space, SpaceError, assert_pool_space


class NotInPool(LookupError):
    pass


def lookup(queries: DataFrame, pool: DataFrame, ids: list[str]) -> DataFrame:
    """Each query row once with the pool row of the same ids, by exact and null-safe equality; a query without one is an error.

    The pool must be unique on ids. Repeats and the queries' other columns are kept.
    """
    right = pool.select(*(F.col(c).alias(f"{c}__pool") for c in ids), *(c for c in pool.columns if c not in ids), F.lit(True).alias("found__"))
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}__pool")) for c in ids))
    clash = [c for c in pool.columns if c not in ids and c in queries.columns]
    joined = queries.drop(*clash).join(right, cond, "left").drop(*(f"{c}__pool" for c in ids))
    lost = joined.where("found__ is null").select(*ids).limit(1).collect()
    if lost:
        raise NotInPool(f"configuration not found in the pool: {lost[0].asDict()}")
    return joined.drop("found__")


class Objective:
    """evaluate() gives its input rows with the codomain's columns. vectorized: takes whole tables."""

    vectorized, pool = True, None

    def __init__(self, domain: Space, codomain: Codomain, id: str = "objective", check: bool = True):
        self.domain, self.codomain, self.id, self.check = domain, codomain, id, check
        if not domain.params:
            raise SpaceError("a domain needs a parameter")

    def evaluate(self, rows: DataFrame) -> DataFrame:
        missing = [c for c in self.domain.ids if c not in rows.columns]
        if missing:
            raise SpaceError(f"missing columns: {', '.join(missing)}")
        if self.check:
            self.domain.assert_table(self.domain.project(rows), unique=False, min_rows=0)
        out = self._evaluate(self.domain.cast(rows))
        lost = [c for c in self.codomain.ids if c not in out.columns]
        if lost:
            raise SpaceError(f"the objective gave no {', '.join(lost)}")
        return out

    def _evaluate(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


class Function(Objective):
    """A function from a table to the table with outputs."""

    def __init__(self, fun: Callable[[DataFrame], DataFrame], domain, codomain, id="function", check=True):
        super().__init__(domain, codomain, id, check)
        self.fun = fun

    def _evaluate(self, rows):
        return self.fun(rows)


class RowFunction(Objective):
    """A Python function of one row, given as a mapping without its nulls, that returns the outputs as a mapping."""

    vectorized = False

    def __init__(self, fun: Callable[[dict], dict], domain, codomain, id="row_function", check=True):
        super().__init__(domain, codomain, id, check)
        self.fun = fun

    def _evaluate(self, rows):
        import pyarrow as pa

        fun, ids, outs = self.fun, self.domain.ids, self.codomain.ids
        made = rows.drop(*outs).withColumns({c: F.lit(None).cast("double") for c in outs})
        names = made.columns

        def run(batches):
            for batch in batches:
                got = [fun({k: v for k, v in row.items() if v is not None}) for row in batch.select(ids).to_pylist()]
                cols = {n: batch.column(n) for n in names} | {c: pa.array([None if g.get(c) is None else float(g[c]) for g in got], pa.float64()) for c in outs}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

        return made.mapInArrow(run, made.schema)


def assert_learner_domain(model: Surrogate, space: Space, domain: Space) -> None:
    """A model fitted on space can serve domain: the same parameters of the same kinds, and no level that it has not seen."""
    if set(space.ids) != set(domain.ids):
        raise SpaceError(f"the model's features are {', '.join(space.ids)}, the domain's {', '.join(domain.ids)}")
    for p in domain.params:
        if space[p.id].kind != p.kind:
            raise SpaceError(f"{p.id} is {space[p.id].kind} for the model and {p.kind} in the domain")
        new = set(p.levels) - set(space[p.id].levels)
        if new:
            raise SpaceError(f"{p.id} has levels that the model doesn't know: {', '.join(sorted(new))}")
    if not vars(model):
        raise SpaceError("the model is not fitted")


class PoolObjective(Objective):
    """Only rows of a pool, unique on the domain, can be evaluated."""

    def __init__(self, pool: DataFrame, domain: Space, codomain: Codomain, id: str = "pool", check: bool = True):
        super().__init__(domain, codomain, id, check)
        assert_pool_space(domain)
        if check:
            pool = domain.assert_table(pool)
        self.pool = pool


class Dataset(PoolObjective):
    """Outputs that the table has already; its columns are the domain's and the codomain's."""

    def __init__(self, table, domain, codomain, id="dataset", check=True):
        if set(table.columns) != {*domain.ids, *codomain.ids}:
            raise SpaceError("the table's columns must be those of domain and codomain")
        super().__init__(table, domain, codomain, id, check)

    def _evaluate(self, rows):
        return lookup(rows, self.pool, self.domain.ids)


class PoolFunction(PoolObjective):
    """A function of whole pool rows, further columns included."""

    def __init__(self, pool, fun: Callable[[DataFrame], DataFrame], domain, codomain, id="pool_function", check=True):
        super().__init__(pool, domain, codomain, id, check)
        self.fun = fun

    def _evaluate(self, rows):
        return self.fun(lookup(rows, self.pool, self.domain.ids))


class PoolWrapper(PoolObjective):
    """An objective restricted to a pool; columns that only it needs come from the pool, others are left out."""

    def __init__(self, pool, objective: Objective, domain: Space | None = None, id="wrapper", check=True):
        super().__init__(pool, domain or objective.domain, objective.codomain, id, check)
        self.inner = objective
        missing = [c for c in objective.domain.ids if c not in pool.columns]
        if missing:
            raise SpaceError(f"the pool has no {', '.join(missing)}")

    def _evaluate(self, rows):
        found = lookup(rows, self.pool, self.domain.ids)
        out = self.inner.evaluate(found)
        return out.select(*rows.columns, *(c for c in self.codomain.ids if c not in rows.columns))


class Learned(Objective):
    """A fitted surrogate for each target; its mean is the output."""

    def __init__(self, models: dict[str, Surrogate] | Surrogate, domain, codomain, id="learner", check=True):
        super().__init__(domain, codomain, id, check)
        self.models = models if isinstance(models, dict) else {codomain.targets[0]: models}
        if set(self.models) != set(codomain.targets):
            raise SpaceError("a model is needed for each target")

    def _evaluate(self, rows):
        for target, model in self.models.items():
            rows = model.predict(rows).withColumnRenamed("mean", target).drop("se")
        return rows
