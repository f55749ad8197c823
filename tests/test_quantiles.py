import itertools
import random

import numpy as np
import pytest

from siftpool.operators.quantiles import LinearQuantiles
from siftpool.operators.surrogates import SurrogateError
from siftpool.space import Space, p_dbl, p_fct, p_int

SPACE = Space((p_dbl("x", 0, 10), p_int("k", 0, 5), p_fct("f", ["a", "b"])))
SCHEMA = "x double, k int, f string, y double"


def loss(at, coef, x, y):
    r = y - coef @ x.T
    return np.maximum(at * r, (at - 1) * r).sum()


@pytest.mark.parametrize("heavy", [False, True])
def test_least_loss_of_all_planes_through_rows(spark, heavy):
    draw = random.Random(5)
    noise = (lambda x: draw.paretovariate(1.2)) if heavy else (lambda x: draw.gauss(0, 0.5 + x))
    rows = [(x := draw.uniform(0, 10), k := draw.randint(0, 5), "a", 100 + 3 * x - 7 * k + noise(x)) for _ in range(45)]
    rows += rows[:9]
    odd = [(None, 1, "a", 5.0), (1.0, None, "b", 5.0), (2.0, 1, None, None), (float("nan"), 1, "a", 2.0)]
    model = LinearQuantiles(0.2, 0.5, 0.9).fit(spark.createDataFrame(rows + odd, SCHEMA), SPACE, "y")
    x, y = np.array([(1.0, r[0], r[1]) for r in rows]), np.array([r[3] for r in rows])
    three = [list(c) for c in itertools.combinations(range(45), 3)]
    planes = [np.linalg.solve(x[c], y[c]) for c in three if abs(np.linalg.det(x[c])) > 1e-6]
    for at, coef in zip(model.at, model.coef):
        assert loss(at, coef, x, y) <= 1.001 * min(loss(at, p, x, y) for p in planes)
    got = model.predict(spark.createDataFrame([(4.0, 2, "b"), (None, 2, "b")], "x double, k int, f string")).collect()
    lo, mid, hi = (float(c @ [1, 4, 2]) for c in model.coef)
    assert (got[0].mean, got[0].se) == pytest.approx((mid, (hi - lo) / 2)) and got[1].mean is None and got[1].se is None


def test_se_follows_noise(spark):
    draw = random.Random(6)
    rows = [(x := draw.uniform(0, 10), 1, "a", 5 + draw.uniform(-1, 1) * x) for _ in range(4000)]
    model = LinearQuantiles(factor=1.0).fit(spark.createDataFrame(rows, SCHEMA), SPACE, "y")  # k without spread
    assert model.ids == ["x"]
    for r in model.predict(spark.createDataFrame([(float(v), 1) for v in (2, 5, 9)], "x double, k int")).collect():
        assert r.se == pytest.approx(1.6 * r.x, rel=0.1) and r.mean == pytest.approx(5, abs=0.4)


def test_small_and_empty(spark):
    one = LinearQuantiles().fit(spark.createDataFrame([(1.0, 2, "a", 7.0)], SCHEMA), SPACE, "y").predict(spark.createDataFrame([(3.0, 1)], "x double, k int")).first()
    assert (one.mean, one.se) == pytest.approx((7, 0), abs=1e-3)
    with pytest.raises(SurrogateError, match="no complete rows"):
        LinearQuantiles().fit(spark.createDataFrame([], SCHEMA), SPACE, "y")
    with pytest.raises(SurrogateError, match="quantiles"):
        LinearQuantiles(0.9, 0.5, 0.1)
