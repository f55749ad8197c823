"""What larger tables showed: ties by exact differences, repeated rows met once, Gower distances by balls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.functions import frames
from siftpool.operators import acquisition as acq, distance as distances
from siftpool.operators.distance import Gower, Standardize
from siftpool.space import Space, p_dbl, p_fct, p_lgl

BOX = Space((p_dbl("a", 0, 50), p_dbl("b", 900, 1000)))
LINE = Space((p_dbl("a", 0, 50),))
MIXED = Space((p_dbl("a", 0, 1), p_fct("c", ["u", "v", "w"]), p_lgl("l")))


@pytest.mark.parametrize("balls", [False, True])
def test_distances_are_of_exact_differences(spark, monkeypatch, balls):
    if balls:
        monkeypatch.setattr(distances, "NEAR", 10, raising=False)
        monkeypatch.setattr(frames, "REFERENCES", 10)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 50, 400), 900 + rng.integers(0, 1000, 400) / 10]).astype(float)
    pool = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(3)
    d = Standardize().fit(pool, BOX).set_references(pool.where("a < 30"))
    (_, s0), (_, s1) = [s[2:] for s in d.stats]
    refs = x[x[:, 0] < 30]
    for r in d.nearest(pool.where("a >= 30")).collect():
        one, two = (r.a - refs[:, 0]) / s0, (r.b - refs[:, 1]) / s1
        assert r.distance == np.sqrt(one * one + two * two).min()


def test_gower_by_balls(spark, monkeypatch):
    monkeypatch.setattr(frames, "REFERENCES", 10)
    monkeypatch.setattr(distances, "over_all", None)  # not all rows by all references
    rng = np.random.default_rng(5)
    value = lambda: (None if rng.random() < 0.2 else float(rng.random()), None if rng.random() < 0.2 else str(rng.choice(["u", "v", "w", "other"])), None if rng.random() < 0.2 else bool(rng.random() < 0.5))
    rows, refs = [(i, *value()) for i in range(60)], [value() for _ in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, c string, l boolean").repartition(3)
    spread = max(r[1] for r in rows if r[1] is not None) - min(r[1] for r in rows if r[1] is not None)

    def plain(x, y):
        parts = [abs(p - q) / spread if k == 0 else float(p != q) for k, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        return sum(parts) / len(parts) if parts else 0.0

    for told in (refs, [r for r in refs if None not in r]):
        got = Gower().fit(df.drop("id"), MIXED).set_references(spark.createDataFrame(told, "a double, c string, l boolean")).nearest(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert np.isclose(r.distance, min(plain((r.a, r.c, r.l), y) for y in told))


@pytest.mark.parametrize("kind", [acq.IGS, acq.Ideal])
def test_repeated_rows_are_met_once(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    done = [(float(a), float(y)) for a, y in zip(rng.integers(0, 10, 300), rng.integers(0, 9, 300))]
    cands = [(i, float(a), float(a) / 2) for i, a in enumerate(rng.integers(0, 15, 500))]
    archive = spark.createDataFrame(done, "a double, y double").repartition(3)
    rows = spark.createDataFrame(cands, "id int, a double, mean double").repartition(3)
    score = kind("affine").fit(rows, LINE).update(archive, "y")
    want = {r.id: r.score for r in score.score(rows).collect()}
    seen, whole = [], distances.over_all

    def met(rows, own, refs, *args):
        seen.append((rows.count(), refs.count()))
        return whole(rows, own, refs, *args)

    monkeypatch.setattr(distances, "over_all", met)
    monkeypatch.setattr(frames, "REFERENCES", 10)
    got = {r.id: r.score for r in score.score(rows).collect()}
    assert seen == [(len({c[1] for c in cands}), len(set(done)))]
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    h, (a, m) = (max(c[1] for c in cands) - min(c[1] for c in cands)) / 2, cands[0][1:]
    d2, r2 = np.array([((a - x) / h) ** 2 for x, _ in done]), np.array([(m - y) ** 2 for _, y in done])
    if kind is acq.IGS:
        assert np.isclose(got[0], np.sqrt(d2 * r2).min())
    elif (d2 <= 1e-12).any():
        assert np.isclose(got[0], r2[d2 <= 1e-12].mean())
    else:
        w = np.exp(-d2) / d2
        assert np.isclose(got[0], (w * r2).sum() / w.sum() + 2 / np.pi * np.arctan(1 / w.sum()))
