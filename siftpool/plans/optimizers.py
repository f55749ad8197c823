"""Loops that propose batches and evaluate them, and ready-made configurations."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from siftpool.functions.frames import anti, by_key, checkpointed, seeded
from siftpool.operators import acquisition as acq
from siftpool.operators import modifiers, proposers, samplers
from siftpool.operators.design import GRID_LIMIT, grid, random_design
from siftpool.operators.surrogates import Bootstrap, NearestNeighbours, NoSurrogate, Surrogate, drawn, placed
from siftpool.plans.search import Combined, Evals, Search, Terminated, Terminator
from siftpool.sources.objectives import Objective
from siftpool.space import Space, SpaceError

NEVER, BETWEEN, WITHIN = "never", "between_batches", "within_batches"


class Optimizer:
    def optimize(self, instance: Search) -> DataFrame:
        """The archive after the search."""
        try:
            self._optimize(instance, self.candidates(instance))
        except Terminated:
            pass
        return instance.rows()

    def candidates(self, instance: Search) -> DataFrame | None:
        """A pool's admissible rows, the grid of a finite space, or nothing for a continuous one."""
        space, pool = instance.space, instance.objective.pool
        if pool is not None:
            if set(space.ids) != set(instance.objective.domain.ids):
                raise SpaceError(f"{type(self).__name__} needs a search space with the ids of the pool's domain")
            rows = checkpointed(space.project(space.pool_candidates(pool)))
            if rows.isEmpty():
                raise SpaceError("no row of the pool is admissible")
            return rows
        if space.finite:
            return checkpointed(grid(instance.spark, space, 1 + max((int(p.upper - p.lower) for p in space.params if p.kind == "int"), default=1), limit=GRID_LIMIT))
        return None

    def _optimize(self, instance: Search, pool: DataFrame | None) -> None:
        raise NotImplementedError


class PoolRandom(Optimizer):
    """Random batches. The last may go beyond the budget."""

    def __init__(self, batch_size: int = 1, max_batches: float = float("inf"), replace: str = NEVER, seed: int = 1):
        self.batch_size, self.max_batches, self.replace, self.seed = batch_size, max_batches, replace, seed

    def _optimize(self, instance, pool):
        ids, k = instance.space.ids, 0
        if pool is not None and self.replace == WITHIN:
            rows = checkpointed(placed(pool, ids))  # sorted and numbered once
            n = rows.count()
        while k < self.max_batches:
            k += 1
            if pool is None:
                batch = random_design(instance.spark, instance.space, self.batch_size, self.seed + k)
            elif self.replace == WITHIN:
                batch = drawn(rows, n, k, self.seed, self.batch_size)
            else:
                left = anti(pool, instance.rows(), ids) if self.replace == NEVER else pool
                batch = left.orderBy(seeded(f"{self.seed}:{k}", ids), *by_key(ids)).limit(self.batch_size)
            batch = checkpointed(batch)
            if batch.isEmpty():
                return
            instance.eval_batch(batch)


class PoolSample(Optimizer):
    """Batches of a space sampler."""

    def __init__(self, sampler: samplers.Sampler, batch_size: int = 1, max_batches: float = float("inf"), replace: str = NEVER, pass_known: bool = True):
        self.sampler, self.batch_size, self.max_batches, self.replace, self.pass_known = sampler, batch_size, max_batches, replace, pass_known

    def _optimize(self, instance, pool):
        if self.sampler.deterministic and not self.pass_known and self.replace != NEVER:
            warnings.warn("a deterministic sampler without known rows gives each batch again", stacklevel=2)
        k = 0
        while k < self.max_batches:
            k += 1
            left = None if pool is None else anti(pool, instance.rows(), instance.space.ids) if self.replace == NEVER else pool
            if left is not None and left.isEmpty():
                return
            known = instance.rows().select(instance.space.ids).distinct() if self.pass_known and instance.archive is not None else None
            instance.eval_batch(self.sampler.sample(self.batch_size, instance.space, left, known, instance.spark))


class ActiveLearning(Optimizer):
    """An initial design, then a proposer's batches until the budget or the pool is used up. Batches are cut to the budget."""

    def __init__(self, proposer: proposers.Proposer, surrogate: Surrogate | None = None, init: samplers.Sampler | None = None, n_init: int | None = None, batch_size: int = 1, replace: str = NEVER):
        self.proposer, self.surrogate, self.init = proposer, surrogate or NoSurrogate(), init or samplers.Conditional(samplers.Uniform(), samplers.Lhs())
        self.n_init, self.batch_size, self.replace = n_init, batch_size, replace

    def _optimize(self, instance, pool):
        ids = instance.space.ids
        instance.surrogate = self.surrogate
        have = instance.rows().select(ids).distinct().count()
        n_init = self.n_init if self.n_init is not None else 4 * len(ids) if have == 0 else 0
        n = int(min(n_init - have, instance.terminator.left(instance)))
        if n > 0:
            left = None if pool is None else anti(pool, instance.rows(), ids)
            known = instance.rows().select(ids).distinct() if have else None
            instance.eval_batch(self.init.sample(n, instance.space, left, known, instance.spark))
        while True:
            n = int(min(self.batch_size, instance.terminator.left(instance)))
            if n < 1:
                raise Terminated
            context = proposers.Context(instance.spark, instance.space, instance.rows(), instance.target, pool, self.replace != NEVER, self.surrogate)
            batch = checkpointed(self.proposer.propose(context, n))
            if batch.isEmpty():
                return
            instance.eval_batch(batch)


def active_learning(learner: Surrogate | Callable[[], Surrogate] | None = None, n_bootstrap: int = 30, batch_size: int = 1, method: str = "greedy", acq_evals: float = 100) -> ActiveLearning:
    """Uncertainty sampling. method: greedy, local_penalization, diversity or constant_liar; a learner without se is bootstrapped."""
    made = learner() if callable(learner) else learner or NearestNeighbours()
    if not made.has_se:
        if not callable(learner):
            raise ValueError("a learner without se must be given as a function that makes one")
        made = Bootstrap(learner, n_bootstrap)
    cand = samplers.Conditional(samplers.Uniform(), samplers.Lhs())
    score = acq.Uncertainty()
    proposer = {
        "greedy": lambda: proposers.Score(score, cand, acq_evals),
        "local_penalization": lambda: proposers.SequentialScore(score, modifiers.LocalPenalization(), cand, acq_evals),
        "diversity": lambda: proposers.SequentialScore(score, modifiers.Diversity(), cand, acq_evals),
        "constant_liar": lambda: proposers.PseudoLabel(score, cand, acq_evals),
    }[method]()
    return ActiveLearning(proposer, made, n_init=max(2, batch_size), batch_size=batch_size)


class _Random(proposers.Proposer):
    """Unseen rows at random, whatever the batch's size."""

    def propose(self, context, n):
        return samplers.Conditional(samplers.Uniform(), samplers.Uniform()).sample(n, context.space, context.proposable, None, context.spark)


def pool_active_learning(method: str, learner: Callable[[], Surrogate] = NearestNeighbours, delta: float = 1.0, n_init: int | None = None, init: samplers.Sampler | None = None, k_qbc: int = 5, batch_size: int = 1) -> ActiveLearning:
    """Regression on a pool. method: gsx, gsy, igs, qbc, ideal or random."""
    surrogate = Bootstrap(learner, k_qbc) if method == "qbc" else learner()
    proposer = {
        "gsx": lambda: proposers.SequentialReference(acq.GSx()),
        "gsy": lambda: proposers.PseudoLabel(acq.GSy()),
        "igs": lambda: proposers.PseudoLabel(acq.IGS()),
        "qbc": lambda: proposers.PseudoLabel(acq.Uncertainty()),
        "ideal": lambda: proposers.PseudoLabel(acq.Ideal("affine", delta=delta)),
        "random": _Random,
    }[method]()
    first = init or {"random": samplers.Uniform, "qbc": samplers.Uniform, "ideal": samplers.KMeans}.get(method, samplers.GSx)()
    return ActiveLearning(proposer, surrogate, first, n_init, batch_size)


def optimize_active(objective: Objective, n_evals: int | None = None, terminator: Terminator | None = None, space: Space | None = None, tracker=None, optimizer: Optimizer | None = None, callbacks=(), forecast=None, forecast_terminator: Terminator | None = None, **args) -> Search:
    """Search with uncertainty sampling, or the optimizer given; the instance holds the archive, and the tracker one row for each batch.

    A forecast's update() gets the tracker's table, one row for each batch, as
    soon as a batch is logged, so it needs a tracker; its terminator ends the
    search by itself.
    """
    if forecast is not None and tracker is None:
        raise ValueError("a forecast needs a tracker")
    ends = [t for t in (Evals(n_evals) if n_evals is not None else None, terminator) if t is not None]
    if not ends:
        raise ValueError("n_evals or a terminator is needed")
    ends += [forecast_terminator] if forecast_terminator is not None else []
    after = [*callbacks, *([tracker.after_batch] if tracker is not None else [])]
    if forecast is not None:
        after.append(lambda instance: forecast.update(tracker.data(instance.spark)))
    instance = Search(objective, ends[0] if len(ends) == 1 else Combined(ends), space, after=after)
    (optimizer or active_learning(**args)).optimize(instance)
    return instance


