"""Search instances: what is evaluated, when to stop, and the archive of results."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpool.functions.frames import checkpointed, empty
from siftpool.sources.objectives import Objective
from siftpool.space import Space


class Terminated(Exception):
    """The search has used what it may."""


class Terminator:
    def done(self, instance: Search) -> bool:
        return False

    def left(self, instance: Search) -> float:
        """Evaluations that may still be made."""
        return float("inf")


class Never(Terminator):
    pass


@dataclass
class Evals(Terminator):
    n: int

    def done(self, instance):
        return instance.n_evals >= self.n

    def left(self, instance):
        return max(0, self.n - instance.n_evals)


@dataclass
class Seconds(Terminator):
    n: float

    def done(self, instance):
        return time.monotonic() - instance.started >= self.n


@dataclass
class Combined(Terminator):
    of: Sequence[Terminator]
    any: bool = True

    def done(self, instance):
        return (any if self.any else all)(t.done(instance) for t in self.of)

    def left(self, instance):
        return (min if self.any else max)((t.left(instance) for t in self.of), default=float("inf"))


class Search:
    """eval_batch() validates rows, evaluates them and adds them to the archive. Whether to stop is asked before a batch only."""

    def __init__(self, objective: Objective, terminator: Terminator | None = None, space: Space | None = None, before: Sequence[Callable] = (), after: Sequence[Callable] = (), spark: SparkSession | None = None):
        self.objective, self.terminator = objective, terminator or Never()
        self.space = space or objective.domain
        self.spark = spark or (objective.pool.sparkSession if objective.pool is not None else SparkSession.active())
        self.before, self.after, self.surrogate = list(before), list(after), None
        self.started, self.n_evals, self.n_batches = time.monotonic(), 0, 0
        self.target = objective.codomain.targets[0]
        self.archive: DataFrame | None = None

    def rows(self) -> DataFrame:
        """The archive, empty but typed before the first batch."""
        if self.archive is not None:
            return self.archive
        fields = [*self.space.struct_type().fields, *(T.StructField(c, T.DoubleType()) for c in self.objective.codomain.ids), T.StructField("batch_nr", T.IntegerType()), T.StructField("timestamp", T.TimestampType())]
        return empty(self.spark, T.StructType(fields))

    @property
    def terminated(self) -> bool:
        return self.terminator.done(self)

    def eval_batch(self, rows: DataFrame) -> DataFrame:
        """The batch with its outputs; Terminated if there is no budget. Rows are archived as they came, not as dependencies and transformations changed them."""
        for f in self.before:
            f(self, rows)
        if self.terminated:
            raise Terminated
        rows = checkpointed(self.space.project(rows))
        n = rows.count()
        if n == 0:
            return rows.withColumns({c: F.lit(None).cast("double") for c in self.objective.codomain.ids})
        if self.objective.check:
            self.space.assert_table(rows, unique=False)
        raw = [f"{c}__raw" for c in self.space.ids]
        given = self.space.apply_design(rows.withColumns({r: F.col(c) for r, c in zip(raw, self.space.ids)}))
        if self.space.trafo is not None:
            given = self.space.trafo(given)
        out = self.objective.evaluate(given)
        out = out.select(*(F.col(r).alias(c) for r, c in zip(raw, self.space.ids)), *self.objective.codomain.ids)
        out = out.withColumn("batch_nr", F.lit(self.n_batches + 1)).withColumn("timestamp", F.current_timestamp())
        self.archive = checkpointed(out if self.archive is None else self.archive.unionByName(out))
        self.n_evals, self.n_batches = self.n_evals + n, self.n_batches + 1
        for f in self.after:
            f(self)
        return self.last_batch()

    def last_batch(self) -> DataFrame:
        """The evaluated rows of the last batch."""
        return self.rows().where(F.col("batch_nr") == self.n_batches)
