"""Nearest references by pivots, and scores over all references in blocks, against plain distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.functions import frames
from siftpool.operators import acquisition, distance as distances, nearest as metric, surrogates
from siftpool.operators.distance import Affine
from siftpool.operators.nearest import balls, nearest, needed, pivots
from siftpool.operators.surrogates import Constant, NearestNeighbours
from siftpool.space import Space, p_dbl

BOX = Space((p_dbl("a", 0, 1), p_dbl("b", 0, 1)))


def frame(spark, x, y=None):
    y = np.arange(len(x), dtype=float) if y is None else y
    return spark.createDataFrame([(*map(float, p), float(t)) for p, t in zip(x, y)], "a double, b double, y double").repartition(4)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(metric, "PIVOTS", 12)


@pytest.mark.parametrize("k,ordered", [(1, False), (4, False), (5, True)])
def test_neighbours_are_the_nearest(spark, small, k, ordered):
    rng = np.random.default_rng(k)
    refs = np.concatenate([rng.normal(0, 1, (1500, 2)), np.repeat([[0.5, 0.5]], 300, axis=0), np.round(rng.random((700, 2)), 1), [[40, 40]]])
    rows = np.concatenate([rng.normal(0, 1.2, (900, 2)), refs[:200], [[-90, 3], [39, 41], [0.5, 0.5]]])
    at = [F.col("a"), F.col("b")]
    got = nearest(frame(spark, rows), at, frame(spark, refs), at, k, ("y",) if ordered else (), ordered).collect()
    assert len(got) == len(rows)
    for r in got:
        d = np.sqrt(((refs - [r.a, r.b]) ** 2).sum(axis=1))
        if ordered:
            order = np.lexsort((np.arange(len(refs)), np.round(d, 9)))[:k]
            assert [int(x.y) for x in r.near] == order.tolist()
        np.testing.assert_allclose([x.d for x in r.near], np.sort(d)[:k], atol=1e-8)


def test_few_or_no_references(spark, small):
    at = [F.col("a"), F.col("b")]
    rows = frame(spark, np.random.default_rng(1).random((50, 2)))
    assert {len(r.near) for r in nearest(rows, at, frame(spark, [[0, 0], [1, 1]]), at, 5).collect()} == {2}
    assert {len(r.near) for r in nearest(rows, at, rows.where("a > 9"), at, 5).collect()} == {0}
    assert nearest(rows.where("a > 9"), at, rows, at, 2).count() == 0


def test_most_pairs_are_never_met(spark, small):
    """Balls that are met hold a small part of all pairs, and the part falls as tables grow."""
    shares = []
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        points = frame(spark, rng.random((n, 2))).select(F.array("a", "b").alias("at"), F.array("y").alias("more"))
        centres = pivots(points)
        own, met = balls(points, centres, 64), balls(points, centres, 64)
        assert own.agg(F.sum("n")).first()[0] == n and own.agg(F.max("n")).first()[0] <= 64
        size = own.select("ball", "n")
        pairs = needed(own, met, 3).join(size, "ball").join(met.select(F.col("ball").alias("other"), F.col("n").alias("m")), "other")
        shares.append(pairs.agg(F.sum(F.col("n") * F.col("m"))).first()[0] / n**2)
    assert shares[0] < 0.6 and shares[1] < 0.4 * shares[0]


@pytest.fixture
def many(monkeypatch, small):
    """As if a hundred references were too many to send."""
    monkeypatch.setattr(frames, "REFERENCES", 100)


def test_scores_are_the_same_by_blocks(spark, monkeypatch, small):
    rng = np.random.default_rng(7)
    pool = frame(spark, np.round(rng.random((700, 2)), 2), np.round(rng.random(700), 3))
    done = pool.where("a < 0.6")
    rest = Constant().fit(done, BOX, "y").predict(pool.where("a >= 0.6"))

    def scores():
        out = {}
        for name, make in {"gsx": acquisition.GSx, "igs": acquisition.IGS, "ideal": lambda d: acquisition.Ideal(d, omega=1.5)}.items():
            got = make(Affine()).fit(pool, BOX).update(done, "y").score(rest).select("a", "b", "y", "score").collect()
            out[name] = sorted((r.a, r.b, r.y, round(r.score, 8)) for r in got)
        knn = NearestNeighbours(5).fit(done, BOX, "y").predict(rest.drop("mean", "se")).select("a", "b", "y", "mean", "se").collect()
        out["knn"] = sorted((r.a, r.b, r.y, round(r["mean"], 8), round(r.se, 8)) for r in knn)
        return out

    sent = scores()
    monkeypatch.setattr(frames, "REFERENCES", 100)
    assert not frames.few(done)
    met = scores()
    assert sent == met


def test_density_takes_no_nested_loop(spark, small):
    rng = np.random.default_rng(8)
    x = np.unique(np.round(rng.random((900, 2)), 2), axis=0)
    pool = frame(spark, x)
    got = {(r.a, r.b): r.density for r in acquisition.density(pool, Affine().fit(pool, BOX), BOX).collect()}
    z = (x - (x.max(axis=0) + x.min(axis=0)) / 2) / ((x.max(axis=0) - x.min(axis=0)) / 2)
    d = np.sort(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), axis=1)[:, 1:3].mean(axis=1) ** 2
    for p, v in zip(x, d[d > 0].min() / d):
        assert np.isclose(got[tuple(p)], v)


def test_output_distance_by_search(spark, monkeypatch, small):
    rng = np.random.default_rng(9)
    y = np.concatenate([np.round(rng.normal(0, 10, 400), 2), [5.0, 5.0]])
    done = frame(spark, rng.random((402, 2)), y).unionByName(spark.createDataFrame([(0.1, 0.1, None), (0.2, 0.2, float("nan"))], "a double, b double, y double"))
    asked = [float(v) for v in rng.normal(0, 15, 300)] + [5.0, None, float("nan"), 1e6, -1e6]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(asked)], "id int, mean double").repartition(3)
    for limit in (20_000, 50):
        monkeypatch.setattr(frames, "REFERENCES", limit)
        got = {r.id: r.score for r in acquisition.GSy().fit(None, BOX).update(done, "y").score(rows).collect()}
        assert len(got) == len(asked)
        for i, m in enumerate(asked):
            assert got[i] is None if m is None or np.isnan(m) else np.isclose(got[i], np.abs(y - m).min(), atol=1e-9)
    nothing = acquisition.GSy().fit(None, BOX).update(done.where("a < 0.15 and y is null"), "y").score(rows)
    assert nothing.where("score is not null").count() == 0


def test_null_and_nan_coordinates_are_the_middle(spark, many):
    refs = frame(spark, np.random.default_rng(3).random((300, 2)))
    d = Affine().fit(refs, BOX).set_references(refs)
    odd = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5), (0.2, None)], "a double, b double")
    assert all(r.distance is not None and r.distance < 0.5 for r in d.nearest(odd).collect())


def test_rows_are_not_broadcast_to_their_neighbours(spark, small):
    """Checkpointed frames seem as small as their files: all rows would go through the driver."""
    rng = np.random.default_rng(8)
    at = [F.col("a"), F.col("b")]
    got = nearest(frame(spark, rng.random((500, 2))), at, frame(spark, rng.random((300, 2))), at, 3, ("y",), True)
    assert len(got.collect()) == 500
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    sums = metric.over_all(frame(spark, rng.random((500, 2))), at, frame(spark, rng.random((300, 2))), at, lambda x, y: np.full((len(x), 1), float(len(y))), np.add, ["n"], "told")
    assert {r.told.n for r in sums.collect()} == {300.0}
    assert "BroadcastHashJoin" not in sums._jdf.queryExecution().executedPlan().toString()
