import math
import warnings

import pytest
from pyspark.sql import functions as F

from siftpool.functions import metrics as M
from siftpool.operators import acquisition as acq
from siftpool.operators import proposers as P
from siftpool.operators.modifiers import Diversity, LocalPenalization
from siftpool.operators.samplers import Lhs, Sampler
from siftpool.operators.gaussian import GaussianProcess
from siftpool.operators.surrogates import Bootstrap, Constant, Linear, NearestNeighbours, NoSurrogate, QuantileNeighbours, SurrogateError, Trees, ensemble_summary
from siftpool.plans.optimizers import ActiveLearning, PoolRandom, PoolSample, active_learning, optimize_active, pool_active_learning
from siftpool.plans.search import Combined, Evals, Search, Terminated, Terminator
from siftpool.sources.objectives import Dataset, Function, Learned, NotInPool, PoolFunction, PoolWrapper
from siftpool.space import Codomain, Needs, Space, SpaceError, p_dbl, p_fct, p_int, p_lgl

Y = Codomain({"y": "minimize"})


def squares(spark, n):
    rows = spark.createDataFrame([(x, float(x * x)) for x in range(1, n + 1)], "x int, y double")
    return Dataset(rows, Space((p_int("x", 1, n),)), Y)


def check(instance, evals, batches=None, distinct=None):
    rows = instance.rows()
    assert rows.count() == evals == instance.n_evals
    assert batches is None or instance.n_batches == batches
    assert rows.select("x").distinct().count() == (evals if distinct is None else distinct)


def test_lookup(spark):
    space = Space((p_int("x1"), p_dbl("x2")))
    pool = spark.createDataFrame([(1, 0.5, "alpha", 11.0), (2, 1.0, "beta", 22.0), (3, 1.5, "gamma", 33.0)], "x1 int, x2 double, candidate_id string, score double")
    obj = PoolFunction(pool, lambda df: df.withColumn("y", F.col("score")), space, Y)
    got = obj.evaluate(spark.createDataFrame([(3, 1.5, 0), (1, 0.5, 1), (1, 0.5, 2)], "x1 int, x2 double, q int")).orderBy("q").collect()
    assert [r.y for r in got] == [33, 11, 11]
    exact = Dataset(spark.createDataFrame([(0.1, 10.0), (None, 20.0)], "x double, y double"), Space((p_dbl("x"),)), Y)
    assert sorted(r.y for r in exact.evaluate(spark.createDataFrame([(0.1,), (None,)], "x double")).collect()) == [10, 20]
    with pytest.raises(NotInPool, match="not found"):
        exact.evaluate(spark.createDataFrame([(0.1 + 1e-10,)], "x double"))
    with pytest.raises(SpaceError, match="columns"):
        Dataset(pool, space, Y)


def test_wrapper(spark):
    inner = Function(lambda df: df.withColumn("y", F.col("z").cast("double") * 10 / 10), Space((p_int("z"),)), Y)
    pool = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "x int, z int")
    got = PoolWrapper(pool, inner, Space((p_int("x"),))).evaluate(spark.createDataFrame([(3,), (1,)], "x int")).orderBy("x").collect()
    assert [r.y for r in got] == [10, 30]
    with pytest.raises(SpaceError, match="duplicate configurations"):
        PoolWrapper(spark.createDataFrame([(1, 10), (1, 20)], "x int, z int"), inner, Space((p_int("x"),)))


def test_eval_batch(spark):
    seen = []
    space = Space((p_lgl("gate"), p_int("x", 1, 3)), (Needs("x", "gate", (True,)),))

    def fun(df):
        seen.append([r.x for r in df.collect()])
        return df.withColumn("y", F.lit(1.0))

    row = spark.createDataFrame([(False, 2)], "gate boolean, x int")
    with pytest.raises(SpaceError, match="gate == TRUE"):
        Search(Function(fun, space, Y), spark=spark).eval_batch(row)
    assert not seen
    unchecked = Search(Function(fun, space, Y, check=False), spark=spark)
    assert unchecked.eval_batch(row).first().x == 2 and set(map(tuple, seen)) == {(None,)}
    empty = Search(Function(fun, space, Y), spark=spark).eval_batch(row.limit(0))
    assert empty.columns == ["gate", "x", "y"] and empty.isEmpty()
    moved = Space((p_dbl("x", 0, 1),), trafo=lambda df: df.withColumn("x", F.col("x") + 1))
    got = Search(Function(lambda df: df.withColumn("y", F.col("x")), Space((p_dbl("x", 0, 2),)), Y), space=moved, spark=spark).eval_batch(spark.createDataFrame([(0.25,)], "x double")).first()
    assert (got.x, got.y) == (0.25, 1.25)
    ended = Search(Function(fun, space, Y), Evals(0), spark=spark)
    with pytest.raises(Terminated):
        ended.eval_batch(row)


def test_loops(spark):
    one = Search(squares(spark, 8), Evals(5))
    ActiveLearning(P.SequentialReference(acq.GSx()), n_init=1, batch_size=2).optimize(one)
    check(one, 5, 3)
    two = Search(squares(spark, 8), Evals(3))
    ActiveLearning(P.Portfolio([P.Score(acq.GSx()), P.Score(acq.GSx("gower"))]), n_init=1, batch_size=2).optimize(two)
    check(two, 3, 2)
    three = Search(squares(spark, 10), Evals(6))
    ActiveLearning(P.PseudoLabel(acq.GSy()), Trees(), n_init=2, batch_size=2).optimize(three)
    check(three, 6, 3)
    for replace, evals in (("never", 2), ("between_batches", 5)):
        four = Search(squares(spark, 2), Evals(5))
        ActiveLearning(P.Score(acq.GSx()), n_init=1, replace=replace).optimize(four)
        check(four, evals, distinct=2)


def test_continuous(spark):
    space = Space((p_dbl("x", 0, 10),))
    bump = Function(lambda df: df.withColumn("y", F.exp(-0.5 * (F.col("x") - 2) ** 2)), space, Y)
    instance = Search(bump, Evals(4), spark=spark)
    ActiveLearning(P.SequentialScore(acq.GSx(), Diversity(), Lhs(), 20), n_init=1, batch_size=3).optimize(instance)
    check(instance, 4, 2)
    with pytest.raises(P.ProposalError):
        P.Score(acq.GSx()).propose(P.Context(spark, space, instance.rows(), "y"), 1)


def test_default_initial_design(spark):
    rows = [(i / 23, (i * 7 % 24) / 23) for i in range(24)]
    table = spark.createDataFrame([(a, b, a * a + b * b) for a, b in rows], "x1 double, x2 double, y double")
    obj = Dataset(table, Space((p_dbl("x1", 0, 1), p_dbl("x2", 0, 1))), Y)
    instance = Search(obj, Evals(9))
    pool_active_learning("gsx").optimize(instance)
    assert instance.rows().where("batch_nr = 1").count() == 8 and instance.n_evals == 9


@pytest.mark.parametrize("method", ["gsy", "igs", "ideal", "qbc", "random"])
def test_pool_methods(spark, method):
    instance = Search(squares(spark, 7), Evals(4))
    pool_active_learning(method, lambda: NearestNeighbours(2), n_init=2, k_qbc=2, batch_size=2).optimize(instance)
    check(instance, 4, 2)


@pytest.mark.parametrize("method", ["greedy", "local_penalization", "diversity", "constant_liar"])
def test_uncertainty_sampling(spark, method):
    tracker = M.tracker("optimize", optimum=1.0)
    instance = optimize_active(squares(spark, 9), 4, tracker=tracker, learner=NearestNeighbours(2), batch_size=2, method=method)
    check(instance, 4, 2)
    assert tracker.n_batches == 2 and tracker.latest["n_evals"] == 4 and tracker.latest["regret"] == tracker.latest["best_y"] - 1
    assert tracker.data(spark).count() == 2


class Trend(Terminator):
    """A forecast and its terminator: ends once the last two batches had the same best output."""

    def __init__(self):
        self.seen, self.flat = [], False

    def update(self, history):
        self.seen.append(history.count())
        best = [r.best_y for r in history.orderBy("batch_nr").collect()]
        self.flat = len(best) > 1 and best[-1] == best[-2]

    def done(self, instance):
        return self.flat


def test_forecasts(spark):
    for with_end in (True, False):
        trend, tracker = Trend(), M.Tracker({"best_y": M.best_y})
        instance = optimize_active(squares(spark, 8), 5, tracker=tracker, optimizer=PoolSample(FirstRows(), 1), forecast=trend, forecast_terminator=trend if with_end else None)
        assert trend.seen == list(range(1, instance.n_batches + 1)) and instance.n_evals == (2 if with_end else 5)
    with pytest.raises(ValueError, match="tracker"):
        optimize_active(squares(spark, 8), 5, forecast=Trend())


class FirstRows(Sampler):
    key = "first"

    def _sample(self, n, space, pool, known, spark):
        if known is not None:
            from siftpool.functions.frames import anti

            pool = anti(pool, known, space.ids)
        return pool.orderBy(*space.ids).limit(n)


def test_random_and_sampled_pools(spark):
    instance = Search(squares(spark, 30), Evals(10))
    PoolRandom(batch_size=3).optimize(instance)
    check(instance, 12, 4)
    within = Search(squares(spark, 3), Evals(6))
    PoolRandom(batch_size=6, replace="within_batches").optimize(within)
    assert within.n_evals == 6
    order = lambda i: [r.x for r in i.rows().orderBy("batch_nr", "x").collect()]
    never = Search(squares(spark, 4))
    PoolSample(FirstRows(), 2, 2).optimize(never)
    assert order(never) == [1, 2, 3, 4]
    again = Search(squares(spark, 4))
    with pytest.warns(UserWarning, match="deterministic"):
        PoolSample(FirstRows(), 2, 2, "between_batches", pass_known=False).optimize(again)
    assert order(again) == [1, 2, 1, 2]
    made = Search(Function(lambda df: df.withColumn("y", F.col("x") * 1.0), Space((p_int("x", 1, 4),)), Y), Evals(4), spark=spark)
    PoolRandom(batch_size=2).optimize(made)
    check(made, 4, 2)


def test_terminators(spark):
    i = Search(squares(spark, 3))
    assert not Combined([Evals(1), Evals(0)], any=False).done(i) and Combined([Evals(1), Evals(0)]).done(i)


def line(spark, n=20):
    return spark.createDataFrame([(float(x), 5.0, 2.0 * x + 1) for x in range(n)], "x double, c double, y double"), Space((p_dbl("x", 0, n), p_dbl("c", 0, 10)))


def test_surrogates(spark):
    data, space = line(spark)
    q = spark.createDataFrame([(3.5, 5.0)], "x double, c double")
    assert Constant().fit(data, space, "y").predict(q).first().mean == 20
    assert Linear().fit(data, space, "y").predict(q).first().mean == pytest.approx(8)
    near = NearestNeighbours(2).fit(data, space, "y").predict(q).first()
    assert (near.mean, near.se) == pytest.approx((8, math.sqrt(2)))
    tree = Trees().fit(data, space, "y").predict(q).first()
    assert abs(tree.mean - 8) < 4 and tree.se is None
    boot = Bootstrap(lambda: NearestNeighbours(1), 5).fit(data, space, "y").predict(q).first()
    assert boot.se >= 0 and math.isfinite(boot.mean)
    quant = QuantileNeighbours(5).fit(data, space, "y").predict(spark.createDataFrame([(10.0, 5.0)], "x double, c double")).first()
    assert (quant.mean, quant.se) == pytest.approx((21, 3.2))
    gp = GaussianProcess().fit(data, space, "y")
    assert gp.ids == ["x"]
    a, b = gp.predict(spark.createDataFrame([(3.5, 5.0), (3.5, 9.0)], "x double, c double")).collect()
    assert a.mean == b.mean == pytest.approx(8, abs=0.2) and a.se >= 0
    with pytest.raises(SurrogateError, match="constant"):
        GaussianProcess().fit(data.withColumn("x", F.lit(1.0)), space, "y")
    with pytest.raises(SurrogateError):
        NoSurrogate().predict(q)
    with pytest.raises(SurrogateError):
        QuantileNeighbours(lower=0.9, upper=0.1)
    learned = Learned(Linear().fit(data, space, "y"), space, Y).evaluate(q).first()
    assert learned.y == pytest.approx(8)
    draws = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0), (2, 1.0, -5.0)], "k int, mu double, s2 double")
    got = {r.k: (r.mean, r.se) for r in ensemble_summary(draws, ["k"]).collect()}
    assert got == {1: (3, 2), 2: (1, 0)}


def test_metrics(spark):
    data, space = line(spark)
    model = Linear().fit(data, space, "y")
    assert (M.best_y(data), M.worst_y(data), M.regret(data, optimum=0.5)) == (1, 39, 0.5)
    off = data.withColumn("y", F.col("y") + 1)
    assert M.model_rmse(data, model, off) == pytest.approx(1) and M.model_mae(data, model, off) == pytest.approx(1)
    assert M.model_r2(data, model, data) == pytest.approx(1)
    flat = data.withColumn("y", F.lit(3.0))
    assert M.model_r2(flat, Constant().fit(flat, space, "y"), flat) == 1 and M.model_r2(flat, model, flat) == -math.inf
    sd = Constant().fit(data, space, "y").se
    assert M.integrated_variance(data, Constant().fit(data, space, "y"), space) == pytest.approx(sd * sd * 200)
    t = M.Tracker({"best": M.make_metric(M.best_y, target="y")})
    t.log_batch(1, data)
    t.add_metric("bad", lambda a, s, **_: 1 / 0)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        t.log_batch(2, data)
    assert said and t.history("bad") == [None, None] and t.get_batch(3) is None
    t.remove_metric("bad", keep_data=False)
    assert t.data(spark).columns == ["batch_nr", "n_evals", "timestamp", "best"]
    with pytest.raises(ValueError):
        M.Tracker({"batch_nr": M.best_y})
    iv = spark.createDataFrame([(1.0, 0.0, 2.0), (5.0, 0.0, 2.0)], "y double, lower double, upper double")
    assert iv.agg(M.interval_coverage(), M.winkler_score(alpha=0.5)).first()[:] == (0.5, 2 + 12 / 2)


def test_stream(spark, tmp_path):
    from siftpool.streaming.history import track_stream

    line(spark)[0].write.parquet(str(tmp_path / "in"))
    t = M.Tracker({"best_y": M.best_y})
    stream = spark.readStream.schema("x double, c double, y double").parquet(str(tmp_path / "in"))
    track_stream(stream, t, str(tmp_path / "archive"), str(tmp_path / "state")).awaitTermination()
    assert t.latest["best_y"] == 1 and t.latest["n_evals"] == 20


def test_penalised_batch(spark):
    instance = Search(squares(spark, 12), Evals(5))
    ActiveLearning(P.SequentialScore(acq.GSx(), LocalPenalization(0.2)), n_init=1, batch_size=2).optimize(instance)
    check(instance, 5)


def test_mixed_types(spark):
    row = [(1, 0.1, "a", True, 10.0)]
    schema = "i int, d double, f string, l boolean, y double"
    obj = Dataset(spark.createDataFrame(row, schema), Space((p_int("i"), p_dbl("d"), p_fct("f", ["a"]), p_lgl("l"))), Y)
    assert obj.evaluate(spark.createDataFrame([r[:4] for r in row], schema.rsplit(",", 1)[0])).first().y == 10
