"""Batches of rows to evaluate: greedy, penalised, sequential and mixed proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import anti, by_key, checkpointed, empty, top, usable
from siftpool.operators.acquisition import Acquisition, GSx as GSxScore
from siftpool.operators.modifiers import Modifier
from siftpool.operators.samplers import CHECKPOINT, Sampler, anti_literals, picked_rows
from siftpool.operators.surrogates import NoSurrogate, Surrogate
from siftpool.space import Space

UTILITY = "utility"


class ProposalError(ValueError):
    pass


class Context:
    """One round's view of pool and archive. Models and scores are made when first asked for, once a round."""

    def __init__(self, spark, space: Space, archive: DataFrame, target: str, pool: DataFrame | None = None, replace: bool = False, surrogate: Surrogate | None = None):
        self.spark, self.space, self.archive, self.target = spark, space, archive, target
        self.pool = None if pool is None else space.project(pool)
        self.replace, self._surrogate, self._fitted = replace, surrogate or NoSurrogate(), None
        self._acquisitions: dict[int, Acquisition] = {}
        self.pending: list[DataFrame] = []

    @property
    def evaluated(self) -> DataFrame:
        return self.space.project(self.archive).distinct()

    @property
    def unevaluated(self) -> DataFrame | None:
        return None if self.pool is None else anti(self.pool, self.evaluated, self.space.ids)

    def pending_rows(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.pending) if self.pending else None

    def add_pending(self, rows: DataFrame) -> None:
        self.pending.append(self.space.project(rows))

    @property
    def proposable(self) -> DataFrame | None:
        if self.pool is None:
            return None
        rows = self.pool if self.replace else self.unevaluated
        waits = self.pending_rows()
        return rows if waits is None else anti(rows, waits, self.space.ids)

    @property
    def surrogate(self) -> Surrogate:
        if self._fitted is None:
            self._fitted = self._surrogate.fit(self.archive, self.space, self.target)
        return self._fitted

    def acquisition(self, acq: Acquisition) -> Acquisition:
        if id(acq) not in self._acquisitions:
            self._acquisitions[id(acq)] = acq.fit(self.pool, self.space).update(self.archive, self.target)
        return self._acquisitions[id(acq)]

    def scored(self, acq: Acquisition, cands: DataFrame) -> DataFrame:
        rows = self.surrogate.predict(cands) if acq.needs_surrogate else cands
        return self.acquisition(acq).score(rows, UTILITY)


class Proposer:
    def propose(self, context: Context, n: int) -> DataFrame:
        """n rows at most, with the space's columns."""
        raise NotImplementedError


class Score(Proposer):
    """The n candidates of the highest scores. Large pools and spaces are first reduced to candidates by a sampler; n candidates or fewer are not scored."""

    def __init__(self, acquisition: Acquisition, sampler: Sampler | None = None, n_candidates: float = float("inf")):
        self.acquisition, self.sampler, self.n_candidates = acquisition, sampler, n_candidates

    def candidates(self, context: Context, n: int) -> DataFrame:
        pool = context.proposable
        if pool is None:
            if self.sampler is None or self.n_candidates == float("inf"):
                raise ProposalError("a sampler and a number of candidates are needed without a pool")
            return self.sampler.sample(int(max(n, self.n_candidates)), context.space, None, context.evaluated, context.spark)
        if self.sampler is not None and self.n_candidates < float("inf") and pool.count() > self.n_candidates:
            return self.sampler.sample(int(max(n, self.n_candidates)), context.space, pool, context.evaluated, context.spark)
        return pool

    def propose(self, context, n):
        cands = checkpointed(self.candidates(context, n))
        if cands.count() <= n:
            return context.space.project(cands)
        return context.space.project(self._pick(context, cands, n))

    def _pick(self, context: Context, cands: DataFrame, n: int) -> DataFrame:
        return top(context.scored(self.acquisition, cands), UTILITY, n, context.space.ids)

    @staticmethod
    def best(rows: DataFrame, ids: list[str], picked: list[dict], also: list[str] = []) -> dict | None:  # noqa: B006
        """The first row (ids and also) of the highest utility (to nine digits) not yet picked; null and -inf are never."""
        u = usable(F.col(UTILITY))
        got = anti_literals(rows, ids, picked).where(u.isNotNull() & (u > float("-inf"))).orderBy(F.desc(F.round(UTILITY, 9)), *by_key(ids)).limit(1).select(*ids, *also).collect()
        return got[0].asDict() if got else None


class SequentialScore(Score):
    """Scored once; each pick changes the utilities of the others through a modifier."""

    def __init__(self, acquisition, modifier: Modifier, sampler=None, n_candidates=float("inf")):
        super().__init__(acquisition, sampler, n_candidates)
        self.modifier = modifier

    def _pick(self, context, cands, n):
        space, ids = context.space, context.space.ids
        rows, picked = checkpointed(context.scored(self.acquisition, cands).select(*ids, UTILITY)), []
        while len(picked) < n:
            chosen = picked_rows(context.spark, picked, space) if picked else None
            waits = context.pending_rows()
            if waits is not None:
                chosen = waits if chosen is None else chosen.unionByName(waits)
            row = self.best(self.modifier.modify(rows, UTILITY, chosen, space), ids, picked)
            if row is None:
                break
            picked.append(row)
        return picked_rows(context.spark, picked, space) if picked else space.empty(context.spark)


class SequentialReference(Score):
    """Each pick becomes a reference of the score, with its predicted output where the score takes outputs; so do rows that wait.

    The archive is met once. A pick changes what a row carries of that by one
    distance, so its cost does not depend on the archive.
    """

    def _pick(self, context, cands, n):
        space, ids, picked = context.space, context.space.ids, []
        acq, archive, waits = self.acquisition.fit(context.pool, space), context.archive, context.pending_rows()
        if waits is not None:
            told = context.surrogate.predict(waits).withColumn(context.target, F.col("mean")).select(*ids, context.target) if acq.needs_surrogate else waits
            archive = archive.unionByName(told, allowMissingColumns=True)
        acq.update(archive, context.target)
        rows = context.surrogate.predict(cands) if acq.needs_surrogate else cands
        rows = checkpointed(acq.begin(rows, UTILITY))
        also = ["mean"] if acq.needs_surrogate else []
        while len(picked) < n and (row := self.best(rows, ids, picked, also)) is not None:
            picked.append(row)
            rows = acq.absorb(rows, row, UTILITY)
            rows = checkpointed(rows) if len(picked) % CHECKPOINT == 0 else rows
        return picked_rows(context.spark, [{c: r[c] for c in ids} for r in picked], space) if picked else space.empty(context.spark)


class PseudoLabel(Score):
    """Each pick joins a working archive with its predicted mean (of the liar, else the surrogate), and models are fitted anew."""

    def __init__(self, acquisition, sampler=None, n_candidates=float("inf"), liar: Surrogate | None = None):
        super().__init__(acquisition, sampler, n_candidates)
        self.liar = liar

    def _pick(self, context, cands, n):
        space, ids, picked = context.space, context.space.ids, []
        work = context.archive.select(*ids, F.col(context.target).cast("double").alias(context.target))
        while len(picked) < n:
            model = context._surrogate.fit(work, space, context.target)
            acq = self.acquisition.fit(context.pool, space)
            acq.update(work, context.target)
            row = self.best(acq.score(model.predict(cands) if acq.needs_surrogate else cands, UTILITY), ids, picked)
            if row is None:
                break
            picked.append(row)
            liar = self.liar.fit(work, space, context.target) if self.liar is not None else model
            label = liar.predict(picked_rows(context.spark, [row], space)).select(*ids, F.col("mean").alias(context.target))
            work = checkpointed(work.unionByName(label))
        return picked_rows(context.spark, picked, space) if picked else space.empty(context.spark)


class Portfolio(Proposer):
    """Proposers in turn, a few rows each; what one proposed the next ones leave out. Ends when all come back empty in a row."""

    def __init__(self, proposers: list[Proposer], each: int = 1):
        self.proposers, self.each = proposers, each

    def propose(self, context, n):
        got, k, idle, parts = 0, 0, 0, []
        while got < n and idle < len(self.proposers):
            rows = checkpointed(self.proposers[k % len(self.proposers)].propose(context, min(self.each, n - got)))
            k += 1
            m = rows.count()
            idle = 0 if m else idle + 1
            if m:
                got += m
                parts.append(rows)
                context.add_pending(rows)
        return reduce(DataFrame.unionByName, parts) if parts else empty(context.spark, context.space.struct_type())
