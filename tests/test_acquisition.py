import math

import pytest
from pyspark.sql import functions as F

from siftpool.operators.acquisition import AcquisitionError, GSx, GSy, IGS, Ideal, density
from siftpool.operators.distance import Distance, Gower
from siftpool.operators.modifiers import Diversity, LocalPenalization
from siftpool.space import Space, p_dbl, p_fct, p_int

SPACE = Space((p_dbl("x", -10, 10),))


class Plain(Distance):
    key, geometric = "plain", False

    def __init__(self, scale=1.0):
        self.scale = scale
        super().__init__()

    def between(self, ref):
        return F.abs(F.col("x") - ref["x"]) * self.scale


def score(spark, acq, archive, xs, pool=None):
    rows = spark.createDataFrame([(float(x), float(x)) for x in archive], "x double, y double")
    acq.fit(None if pool is None else spark.createDataFrame([(float(p),) for p in pool], "x double"), SPACE)
    acq.update(rows, "y")
    cands = spark.createDataFrame([(float(x), x + 0.5, 0.1) for x in xs], "x double, mean double, se double")
    return [r.score for r in acq.score(cands).orderBy("x").collect()]


def test_gsx_gsy_igs(spark):
    assert score(spark, GSx(Plain(3.0)), [0, 4], [1]) == [3]
    assert score(spark, GSy(), [0, 4], [1, 10]) == pytest.approx([1.5, 6.5], abs=1e-12)
    assert score(spark, IGS(Plain()), [0, 4], [1, 10]) == pytest.approx([1.5, 39], abs=1e-12)
    with pytest.raises(AcquisitionError, match="no reference points"):
        score(spark, GSx(Plain()), [], [1])


def test_ideal(spark):
    assert score(spark, Ideal(Plain(), delta=0.5), [0, 4], [0, 2]) == pytest.approx([0.25, 4.7470850570210175], abs=1e-12)
    assert score(spark, Ideal(Plain(), delta=0, omega=2), [0, 10], [0, 10], [0, 4, 10]) == pytest.approx([0.75, 0.5833333333333334], abs=1e-12)
    assert score(spark, Ideal(Plain(), delta=0, omega=2), [0, 4], [0, 2]) == pytest.approx([0.75, 12.75], abs=1e-12)
    with pytest.raises(AcquisitionError, match="fitted pool"):
        score(spark, Ideal(Plain(), omega=2), [0, 4], [2], [0, 4, 8])


def test_ideal_does_not_underflow(spark):
    acq = Ideal(Plain(), delta=1, tolerance=0)
    acq.fit(None, SPACE)
    acq.update(spark.createDataFrame([(math.sqrt(1000), 2.0), (-math.sqrt(1001), 10.0)], "x double, y double"), "y")
    got = acq.score(spark.createDataFrame([(0.0, 0.0, 0.1)], "x double, mean double, se double")).first().score
    assert got == pytest.approx(30.799515494390317, abs=1e-9)


def test_density(spark):
    pool = spark.createDataFrame([(0.0,), (4.0,), (10.0,), (10.0,)], "x double")
    got = density(pool, Plain().fit(pool, SPACE), SPACE).orderBy("x").collect()
    assert [r.density for r in got] == pytest.approx([1, 1, 2 / 3])
    assert density(pool.limit(1), Plain().fit(pool, SPACE), SPACE).first().density == 1


def test_modifiers(spark):
    space = Space((p_dbl("x", 0, 1), p_int("z", 1, 11), p_fct("group", ["a", "b"])))
    schema = "x double, z int, group string"
    cands = spark.createDataFrame([(0.0, 1, "a", 1.0), (0.2, 1, "a", 2.0), (0.8, 11, "b", 4.0), (1.0, 6, "b", 8.0)], f"{schema}, u double")
    chosen = spark.createDataFrame([(0.0, 1, "a"), (1.0, 6, "b")], schema)
    near = [r.d for r in Gower("minmax_space").fit(None, space).set_references(chosen).nearest(cands, "d").orderBy("x").collect()]
    assert near == pytest.approx([0, 0.2 / 3, 0.7 / 3, 0])
    got = lambda m, s=chosen: [r.u for r in m.modify(cands, "u", s, space).orderBy("x").collect()]
    assert got(LocalPenalization(0.1, 10)) == pytest.approx([-9, -8, 4, -2])
    assert got(LocalPenalization(0.1)) == [-math.inf, -math.inf, 4, -math.inf]
    assert got(Diversity(0.4)) == pytest.approx([0, 0.2, 0.657142857142857, 0.6], abs=1e-12)
    assert got(Diversity(0.4), None) == got(Diversity(0)) == got(LocalPenalization(0)) == [1, 2, 4, 8]
