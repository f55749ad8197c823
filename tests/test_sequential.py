"""References absorbed one by one give the scores of all references at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.operators import acquisition as acq
from siftpool.operators import proposers as P
from siftpool.operators.surrogates import Linear
from siftpool.space import Space, p_dbl

BOX = Space((p_dbl("a", 0, 1), p_dbl("b", 0, 1)))


def frames(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((80, 2)), 3)
    pool = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    done = spark.createDataFrame([(float(a), float(b), float(a * a - b)) for a, b in x[:15]], "a double, b double, y double")
    return pool, done


@pytest.mark.parametrize("make", [lambda: acq.GSx("affine"), lambda: acq.IGS("affine"), lambda: acq.IGS("gower"), lambda: acq.GSy(), lambda: acq.Ideal("affine"), lambda: acq.Ideal("affine", omega=2.0), lambda: acq.Ideal("gower")])
def test_absorbed_references(spark, make):
    pool, done = frames(spark)
    model = Linear().fit(done, BOX, "y")
    cands = model.predict(pool)
    more = [{"a": 0.3, "b": 0.7, "mean": 0.2}, {**cands.first().asDict()}, {"a": 0.9, "b": 0.1, "mean": -0.5}]
    one = make().fit(pool, BOX).update(done, "y")
    rows = one.begin(cands, "score")
    for r in more:
        rows = one.absorb(rows, r, "score")
    told = done.unionByName(spark.createDataFrame([(r["a"], r["b"], r["mean"]) for r in more], "a double, b double, y double"))
    all_at_once = make().fit(pool, BOX).update(told, "y").score(cands, "score")
    got, want = ({(r.a, r.b): r.score for r in d.collect()} for d in (rows, all_at_once))
    assert got.keys() == want.keys()
    for k in got:
        assert np.isclose(got[k], want[k], rtol=1e-9, atol=1e-12), k


def test_picks_with_outputs_and_waiting_rows(spark):
    """Every pick changes the scores of the rest, and rows that wait count with their predictions."""
    pool, done = frames(spark)
    for make in (lambda: acq.IGS("affine"), lambda: acq.Ideal("affine")):
        context = P.Context(spark, BOX, done, "y", pool, surrogate=Linear())
        got = P.SequentialReference(make()).propose(context, 5)
        assert got.distinct().count() == 5
        # the same by scoring all references anew for each pick
        model, picked = Linear().fit(done, BOX, "y"), []
        rest = context.unevaluated
        while len(picked) < 5:
            told = done if not picked else done.unionByName(model.predict(spark.createDataFrame(picked, "a double, b double")).select("a", "b", F.col("mean").alias("y")))
            rows = make().fit(pool, BOX).update(told, "y").score(model.predict(rest), "score").collect()
            picked.append(min(((r.a, r.b) for r in rows if (r.a, r.b) not in picked), key=lambda p: (-round(next(r.score for r in rows if (r.a, r.b) == p), 9), p)))
        assert {(r.a, r.b) for r in got.collect()} == set(picked)
        context.add_pending(spark.createDataFrame(picked[:2], "a double, b double"))
        again = {(r.a, r.b) for r in P.SequentialReference(make()).propose(context, 3).collect()}
        assert again == set(picked[2:])


def test_others_take_no_references(spark):
    with pytest.raises(acq.AcquisitionError):
        acq.Uncertainty().absorb(None, {})
