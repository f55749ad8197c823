"""Search metrics and their history by batch."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.operators.design import lhs_design
from siftpool.operators.surrogates import Surrogate
from siftpool.space import Space

Metric = Callable[..., float | None]


class Mergeable:
    """A metric of the archive by a state that batches add to.

    parts(target) are aggregates of any rows, merge() puts the states of two
    sets of rows together, value(state, arguments) is the metric. Called as any
    metric, it aggregates the whole archive.
    """

    def __init__(self, parts: Callable[[str], dict[str, Column]], merge: Callable[[dict, dict], dict], value: Callable[[dict, dict], float | None], doc: str = "", fixed: dict | None = None):
        self.parts, self.merge, self.value, self.fixed = parts, merge, value, fixed or {}
        self.__doc__ = doc or self.__doc__

    def filled(self, **fixed) -> Mergeable:
        return Mergeable(self.parts, self.merge, self.value, self.__doc__, self.fixed | fixed)

    def columns(self, args: dict) -> dict[str, Column]:
        return self.parts((self.fixed | args).get("target", "y"))

    def result(self, state: dict, args: dict) -> float | None:
        return self.value(state, self.fixed | args)

    def __call__(self, archive: DataFrame, surrogate: Surrogate | None = None, **args) -> float | None:
        return self.result(archive.agg(*(c.alias(n) for n, c in self.columns(args).items())).first().asDict(), args)


def _extreme(choose: Callable) -> Callable[[dict, dict], dict]:
    def merge(a: dict, b: dict) -> dict:
        return {n: b[n] if a[n] is None else a[n] if b[n] is None else choose(a[n], b[n]) for n in a}

    return merge


def _moments(a: dict, b: dict) -> dict:
    """States with a count n, a mean and a sum of squares about it of outputs, and a sum of squared residuals."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    n, apart = a["n"] + b["n"], b["mean_y"] - a["mean_y"]
    return {"n": n, "mean_y": a["mean_y"] + apart * b["n"] / n, "about": a["about"] + b["about"] + apart * apart * a["n"] * b["n"] / n, "left": a["left"] + b["left"], "size": a["size"] + b["size"]}


def _residual_parts(target: str) -> dict[str, Column]:
    known = F.col(target).isNotNull() & F.col("mean").isNotNull()
    y = F.when(known, F.col(target).cast("double"))
    off = y - F.col("mean")
    return {"n": F.count(y), "mean_y": F.avg(y), "about": F.var_pop(y) * F.count(y), "left": F.coalesce(F.sum(off * off), F.lit(0.0)), "size": F.coalesce(F.sum(F.abs(off)), F.lit(0.0))}


def _r2(s: dict, _) -> float | None:
    if not s["n"]:
        return None
    return 1 - s["left"] / s["about"] if s["about"] > 0 else 1.0 if s["left"] == 0 else float("-inf")


best_y = Mergeable(lambda y: {"least": F.min(y)}, _extreme(min), lambda s, _: s["least"], "The smallest output, whatever the goal.")
worst_y = Mergeable(lambda y: {"most": F.max(y)}, _extreme(max), lambda s, _: s["most"], "The largest output, whatever the goal.")
regret = Mergeable(lambda y: {"least": F.min(y)}, _extreme(min), lambda s, args: None if s["least"] is None else s["least"] - args.get("optimum", 0.0), "The smallest output less the optimum.")
archive_rmse = Mergeable(_residual_parts, _moments, lambda s, _: (s["left"] / s["n"]) ** 0.5 if s["n"] else None, "Extension: root mean squared residual of evaluated rows that carry their prediction in mean.")
archive_mae = Mergeable(_residual_parts, _moments, lambda s, _: s["size"] / s["n"] if s["n"] else None, "Extension: mean absolute residual of evaluated rows that carry their prediction in mean.")
archive_r2 = Mergeable(_residual_parts, _moments, _r2, "Extension: share of the outputs' spread that predictions in mean explain.")
simple_regret = regret


def _residual(target: str) -> Column:
    return F.col("mean") - F.col(target)


def model_rmse(archive: DataFrame, surrogate: Surrogate, test_data: DataFrame, target: str = "y", **_) -> float:
    return surrogate.predict(test_data).agg(F.sqrt(F.avg(_residual(target) * _residual(target)))).first()[0]


def model_mae(archive: DataFrame, surrogate: Surrogate, test_data: DataFrame, target: str = "y", **_) -> float:
    return surrogate.predict(test_data).agg(F.avg(F.abs(_residual(target)))).first()[0]


def r_squared(target: str = "y", mean: str = "mean") -> Column:
    """1 - SSres / SStot as an aggregate; without spread 1 for exact predictions, else -inf."""
    y, m = F.col(target).cast("double"), F.col(mean).cast("double")
    left, total = F.sum((y - m) * (y - m)), F.var_pop(y) * F.count(y)
    return F.when(total > 0, F.lit(1.0) - left / F.when(total > 0, total)).when(left == 0, F.lit(1.0)).otherwise(F.lit(float("-inf")))


def model_r2(archive: DataFrame, surrogate: Surrogate, test_data: DataFrame, target: str = "y", **_) -> float:
    return surrogate.predict(test_data).agg(r_squared(target)).first()[0]


def _grid(archive: DataFrame, grid: DataFrame | None, space: Space | None) -> DataFrame:
    if grid is not None:
        return grid
    if space is None:
        raise ValueError("a grid or a space is needed")
    return lhs_design(archive.sparkSession, space, 100)


def variances(archive: DataFrame, surrogate: Surrogate, space: Space, grid: DataFrame | None = None) -> tuple[float, float, float]:
    """The mean, maximal and integrated variance of one prediction."""
    square = F.col("se") * F.col("se")
    mean, most = surrogate.predict(_grid(archive, grid, space)).agg(F.avg(square), F.max(square)).first()
    return mean, most, None if mean is None else mean * space.volume()


def mean_variance(archive: DataFrame, surrogate: Surrogate, grid: DataFrame | None = None, space: Space | None = None, **_) -> float:
    return surrogate.predict(_grid(archive, grid, space)).agg(F.avg(F.col("se") * F.col("se"))).first()[0]


def max_variance(archive: DataFrame, surrogate: Surrogate, grid: DataFrame | None = None, space: Space | None = None, **_) -> float:
    return surrogate.predict(_grid(archive, grid, space)).agg(F.max(F.col("se") * F.col("se"))).first()[0]


def integrated_variance(archive: DataFrame, surrogate: Surrogate, space: Space, grid: DataFrame | None = None, **_) -> float:
    return mean_variance(archive, surrogate, grid, space) * space.volume()


def make_metric(fun: Metric, **fixed) -> Metric:
    """A metric with arguments filled in; those of the call win."""
    if isinstance(fun, Mergeable):
        return fun.filled(**fixed)

    @functools.wraps(fun)
    def metric(archive, surrogate=None, **args):
        return fun(archive, surrogate, **fixed | args)

    return metric


def interval_coverage(target: str = "y", lower: str = "lower", upper: str = "upper") -> Column:
    """Extension: the share of outputs inside their intervals, as an aggregate."""
    return F.avg(F.col(target).between(F.col(lower), F.col(upper)).cast("double"))


def winkler_score(target: str = "y", lower: str = "lower", upper: str = "upper", alpha: float = 0.1) -> Column:
    """Extension: the mean Winkler score of intervals, as an aggregate."""
    y, lo, hi = F.col(target), F.col(lower), F.col(upper)
    return F.avg(hi - lo + F.when(y < lo, (lo - y) * (2 / alpha)).when(y > hi, (y - hi) * (2 / alpha)).otherwise(0.0))


RESERVED = ("batch_nr", "n_evals", "timestamp")


class Tracker:
    """Metrics of the whole archive after each batch, one row a batch. A metric that fails or gives no number is null, with a warning.

    Where a batch comes with its rows, mergeable metrics and the number of
    evaluations follow from those and the state so far, in one aggregation of
    the batch; only other metrics read the archive.
    """

    def __init__(self, metrics: dict[str, Metric], extra: dict | None = None):
        if any(m in RESERVED for m in metrics):
            raise ValueError(f"metrics can't be named {', '.join(RESERVED)}")
        self.metrics, self.extra = dict(metrics), dict(extra or {})
        self.clear()

    def clear(self) -> None:
        self._rows: list[dict] = []
        self._states: dict[str, dict] = {}  # of mergeable metrics, by name
        self._n: int | None = None  # rows that the states stand for

    def _told(self, rows: DataFrame, args: dict) -> tuple[int, dict[str, dict]]:
        """The number of rows and the states of all mergeable metrics, in one aggregation; of each alone, with a warning, if that fails."""
        parts = {n: f.columns(args) for n, f in self.metrics.items() if isinstance(f, Mergeable)}
        try:
            row = rows.agg(F.count("*").alias("n"), *(c.alias(f"{i}_{k}") for i, cols in enumerate(parts.values()) for k, c in cols.items())).first()
            return row["n"], {n: {k: row[f"{i}_{k}"] for k in cols} for i, (n, cols) in enumerate(parts.items())}
        except Exception:  # noqa: BLE001  a metric must not end a search
            states = {}
            for n, cols in parts.items():
                try:
                    states[n] = rows.agg(*(c.alias(k) for k, c in cols.items())).first().asDict()
                except Exception as e:  # noqa: BLE001
                    warnings.warn(f"metric {n}: {e}", stacklevel=3)
            return rows.count(), states

    def log_batch(self, batch_nr: int, archive: DataFrame, surrogate: Surrogate | None = None, batch: DataFrame | None = None, **args) -> dict:
        """A row of metrics of the archive, which holds the batch; without batch, all of the archive is read."""
        args = self.extra | args
        if batch is None or self._n is None:  # also a tracker without a state yet
            self._n, self._states = self._told(archive, args)
        else:
            n, states = self._told(batch, args)
            late = [m for m, f in self.metrics.items() if isinstance(f, Mergeable) and m in states and m not in self._states]
            self._n += n
            self._states = {m: self.metrics[m].merge(self._states[m], s) for m, s in states.items() if m in self._states}
            if late:  # added since: once from the whole archive
                own = self._told(archive, args)[1]
                self._states |= {m: own[m] for m in late if m in own}
        row = {"batch_nr": batch_nr, "n_evals": self._n, "timestamp": datetime.now(timezone.utc)}
        for name, fun in self.metrics.items():
            try:
                if isinstance(fun, Mergeable):
                    got = fun.result(self._states[name], args) if name in self._states else None
                else:
                    got = fun(archive, surrogate, **args)
                row[name] = None if got is None else float(got)
            except Exception as e:  # noqa: BLE001  a metric must not end a search
                warnings.warn(f"metric {name}: {e}", stacklevel=2)
                row[name] = None
        self._rows.append(row)
        return row

    def after_batch(self, instance) -> None:
        model = instance.surrogate
        if model is not None:
            model = model.fit(instance.rows(), instance.space, instance.target)
        known = self._n is not None and self.latest is not None and self.latest["batch_nr"] == instance.n_batches - 1
        self.log_batch(instance.n_batches, instance.rows(), model, instance.last_batch() if known else None, **{"target": instance.target, "space": instance.space} | self.extra)

    def add_metric(self, name: str, fun: Metric, backfill: bool = False) -> None:
        if name in RESERVED or name in self.metrics:
            raise ValueError(f"{name} is taken")
        if backfill and self._rows:
            warnings.warn("earlier batches can't be computed again; they stay null", stacklevel=2)
        self.metrics[name] = fun

    def remove_metric(self, name: str, keep_data: bool = True) -> None:
        del self.metrics[name]
        if not keep_data:
            for r in self._rows:
                r.pop(name, None)

    def set_extra(self, **extra) -> None:
        self.extra |= extra

    @property
    def n_batches(self) -> int:
        return len(self._rows)

    @property
    def latest(self) -> dict | None:
        return dict(self._rows[-1]) if self._rows else None

    def get_batch(self, batch_nr: int) -> dict | None:
        return next((dict(r) for r in self._rows if r["batch_nr"] == batch_nr), None)

    def history(self, name: str) -> list[float | None]:
        return [r.get(name) for r in self._rows]

    def data(self, spark: SparkSession) -> DataFrame:
        """The history as a table."""
        names = list(dict.fromkeys([*self.metrics, *(k for r in self._rows for k in r if k not in RESERVED)]))
        schema = "batch_nr int, n_evals bigint, timestamp timestamp" + "".join(f", `{n}` double" for n in names)
        return spark.createDataFrame([tuple(r.get(c) for c in (*RESERVED, *names)) for r in self._rows], schema)


def tracker(goal: str = "both", metrics: dict[str, Metric] | None = None, **extra) -> Tracker:
    """Usual metrics of a goal: optimize, learn or both."""
    own: dict[str, Metric] = {}
    if goal in ("optimize", "both"):
        own["best_y"] = best_y
        if "optimum" in extra:
            own["regret"] = regret
    if goal in ("learn", "both"):
        own["mean_variance"] = mean_variance
        if "test_data" in extra:
            own["rmse"] = model_rmse
    if not own:
        raise ValueError("goal is optimize, learn or both")
    return Tracker(own | (metrics or {}), extra)
