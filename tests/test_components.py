import pytest

from siftpool.functions.identity import configured, identity_hash, settings_hash
from siftpool.functions.resampling import holdout, window_folds
from siftpool.functions.stored import load_surrogate, save_surrogate
from siftpool.operators.samplers import sampler
from siftpool.operators.surrogates import Bootstrap, Linear, NearestNeighbours, Trees
from siftpool.plans.search import Evals
from siftpool.sources.objectives import RowFunction, assert_learner_domain
from siftpool.space import Codomain, Space, SpaceError, p_dbl, p_fct, p_lgl

SPACE = Space((p_dbl("x", 0, 20),))


def test_hashes():
    a, b, c = sampler("uniform", seed=1), sampler("uniform", seed=1), sampler("uniform", seed=2)
    assert settings_hash(a) == settings_hash(b) != settings_hash(c) and identity_hash(a) == identity_hash(c) != identity_hash(sampler("lhs"))
    d = configured(a, seed=5)
    assert d.seed == 5 and a.seed == 1 and settings_hash(Evals(1)) != settings_hash(Evals(2))
    with pytest.raises(TypeError, match="no colour"):
        configured(a, colour=1)


@pytest.mark.parametrize("make", [Linear, Trees, lambda: Bootstrap(Trees, 2), lambda: Bootstrap(Linear, 2)])
def test_stored_models(spark, tmp_path, make):
    data = spark.createDataFrame([(float(x), 2.0 * x) for x in range(20)], "x double, y double")
    model = make().fit(data, SPACE, "y")
    save_surrogate(model, str(tmp_path / "m"), spark)
    again = load_surrogate(str(tmp_path / "m"), spark)
    told = lambda m: [(r.x, r.mean) for r in m.predict(data.select("x")).orderBy("x").collect()]
    assert told(again) == told(model)


def test_row_function(spark):
    space = Space((p_dbl("x"), p_lgl("flag")))
    df = spark.createDataFrame([(1.0, True, "a"), (None, False, "b")], "x double, flag boolean, y string")
    got = RowFunction(lambda r: {"y": len(r)}, space, Codomain({"y": "minimize"})).evaluate(df).orderBy("y").collect()
    assert [r.y for r in got] == [1, 2]


def test_learner_domain(spark):
    model = NearestNeighbours().fit(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), SPACE, "y")
    assert_learner_domain(model, SPACE, SPACE)
    for fitted, asked, said in ((SPACE, Space((p_dbl("z"),)), "features"), (SPACE, Space((p_lgl("x"),)), "kind|is dbl"), (Space((p_fct("x", ["a"]),)), Space((p_fct("x", ["a", "b"]),)), "levels")):
        with pytest.raises(SpaceError, match=said):
            assert_learner_domain(model, fitted, asked)


def test_resampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert 600 < holdout(df, ["k"]).where("role = 'train'").count() < 730
    got = window_folds(spark.range(1, 11).withColumnRenamed("id", "t"), "t", 2, 2, 3).collect()
    told = {(f, r): sorted(x.t for x in got if (x.fold, x.role) == (f, r)) for f in (0, 1) for r in ("train", "test")}
    assert told == {(0, "test"): [9, 10], (0, "train"): [6, 7, 8], (1, "test"): [7, 8], (1, "train"): [4, 5, 6]}
    assert window_folds(spark.range(1, 4).withColumnRenamed("id", "t"), "t", 1, 1).count() == 3
    assert window_folds(spark.range(0).withColumnRenamed("id", "t"), "t", 1, 1).count() == 0
