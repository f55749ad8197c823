"""k-medoids by one pass for all exchanges, and Gower distances in blocks, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.functions import frames
from siftpool.operators.distance import Affine, Gower
from siftpool.operators.samplers import KMedoids
from siftpool.space import Space, p_dbl, p_fct, p_lgl

BOX = Space((p_dbl("a", 0, 1), p_dbl("b", 0, 1)))
MIXED = Space((p_dbl("a", 0, 1), p_fct("c", ["u", "v", "w"]), p_lgl("l")))


def plain_pam(d, n, pool, fixed):
    """Building and exchanges on a whole matrix; pool and fixed are row numbers in the order of their ids. Also the number of exchanges."""
    base = lambda own: d[:, own].min(axis=1) if own else np.full(len(d), np.inf)
    first = lambda costs: min(costs, key=lambda x: (round(x[0], 9), x[1]))
    picked, swaps = [], 0
    for _ in range(n):
        picked.append(first([(np.minimum(d[:, j], base(fixed + picked)).sum(), j) for j in pool if j not in picked])[1])
    while True:
        cost, best = base(fixed + picked).sum(), None
        for k in range(n):
            left = fixed + picked[:k] + picked[k + 1 :]
            c, j = first([(np.minimum(d[:, j], base(left)).sum(), j) for j in pool if j not in picked])
            if best is None or c < best[0] - 1e-9:
                best = (c, k, j)
        if best[0] >= cost - 1e-9:
            return picked, swaps
        picked[best[1]] = best[2]
        swaps += 1


@pytest.mark.parametrize("blocks", [False, True])
def test_exchanges_are_those_of_the_whole_matrix(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(frames, "REFERENCES", 20)
    swaps = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.unique(np.round(np.concatenate([rng.normal(c, 0.1, (18, 2)) for c in ([0, 0], [0, 1], [1, 0.4])] + [rng.random((6, 2))]), 3), axis=0)
        known = x[:2] if seed else x[:0]
        pool = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(3)
        told = spark.createDataFrame([tuple(map(float, p)) for p in known], "a double, b double")
        got = {(r.a, r.b) for r in KMedoids(Affine()).sample(4, BOX, pool, told).collect()}
        rows = np.concatenate([x, known])
        z = (rows - (rows.max(axis=0) + rows.min(axis=0)) / 2) / ((rows.max(axis=0) - rows.min(axis=0)) / 2)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        picked, n = plain_pam(d, 4, list(range(len(x))), list(range(len(x), len(rows))))
        assert got == {tuple(x[j]) for j in picked}
        swaps += n
    assert swaps > 0


@pytest.mark.parametrize("blocks", [False, True])
def test_gower_in_blocks(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(frames, "REFERENCES", 10)
    rng = np.random.default_rng(5)
    value = lambda: (None if rng.random() < 0.2 else float(rng.random()), None if rng.random() < 0.2 else str(rng.choice(["u", "v", "w", "other"])), None if rng.random() < 0.2 else bool(rng.random() < 0.5))
    rows = [(i, *value()) for i in range(60)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, c string, l boolean").repartition(3)
    refs = [value() for _ in range(25)]
    d = Gower().fit(df.drop("id"), MIXED).set_references(spark.createDataFrame(refs, "a double, c string, l boolean"))
    spread = max(r[1] for r in rows if r[1] is not None) - min(r[1] for r in rows if r[1] is not None)

    def plain(x, y):
        parts = [abs(p - q) / spread if k == 0 else float(p != q) for k, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        return sum(parts) / len(parts) if parts else 0.0

    for r in d.nearest(df).collect():
        assert np.isclose(r.distance, min(plain((r.a, r.c, r.l), y) for y in refs))
    none = Gower().fit(df.drop("id"), MIXED).set_references(df.drop("id").limit(0))
    assert none.nearest(df).where(F.col("distance").isNotNull()).count() == 0
