import random

import numpy as np
import pytest

from siftpool.operators.surrogates import Bootstrap, Constant, Linear, NearestNeighbours, SurrogateError, resample
from siftpool.space import Space, p_dbl, p_fct

SPACE = Space((p_dbl("x", 0, 10), p_dbl("z", 0, 10), p_fct("f", ["a", "b"])))
SCHEMA = "x double, z double, f string, y double"


def archive(spark, n=300):
    draw = random.Random(8)
    rows = [(x := draw.uniform(0, 10), z := draw.uniform(0, 10), draw.choice("ab"), 2 * x - z + draw.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame([*rows, *rows[:40], (None, 1.0, "a", 3.0), (1.0, 2.0, None, None)], SCHEMA)


@pytest.mark.parametrize("make", [Linear, Constant])
def test_models_of_all_resamples_together(spark, make):
    data = archive(spark)
    boot = Bootstrap(make, 4, seed=3).fit(data, SPACE, "y")
    each = [make().fit(resample(data, [*SPACE.ids, "y"], b, 3), SPACE, "y") for b in range(4)]
    for own, one in zip(boot.models, each):
        assert own.form()[0] == pytest.approx(one.form()[0]) and own.form()[1] == one.form()[1] and own.se == pytest.approx(one.se)
    asked = data.dropna().withColumnRenamed("y", "se")  # a column of that name is replaced
    got = asked.transform(boot.predict)
    assert got.columns == ["x", "z", "f", "se", "mean"]
    for r in got.limit(50).collect():
        means = [float(c @ [1.0, *(r[i] for i in ids)]) for c, ids in (m.form() for m in each)]
        assert (r.mean, r.se) == pytest.approx((np.mean(means), np.std(means, ddof=1)))
    if make is Linear:
        assert boot.predict(data.where("x IS NULL")).first().mean is None


def test_other_models_go_one_by_one(spark):
    data = archive(spark, 40).dropna()
    boot = Bootstrap(lambda: NearestNeighbours(2), 3, seed=3).fit(data, SPACE, "y")
    each = [NearestNeighbours(2).fit(resample(data, [*SPACE.ids, "y"], b, 3), SPACE, "y").predict(data) for b in range(3)]
    key = lambda r: tuple(r[c] for c in "xzfy")
    told = [{key(r): r.mean for r in e.collect()} for e in each]
    for r in boot.predict(data).collect():
        means = [t[key(r)] for t in told]
        assert (r.mean, r.se) == pytest.approx((np.mean(means), np.std(means, ddof=1)))


def test_nothing_to_fit(spark):
    empty = archive(spark).limit(0)
    with pytest.raises(SurrogateError, match="no complete rows"):
        Bootstrap(Linear, 2).fit(empty, SPACE, "y")
    assert Bootstrap(Constant, 2).fit(empty, SPACE, "y").predict(archive(spark)).first().mean is None
