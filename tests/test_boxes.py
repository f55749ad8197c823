"""k-medoids that leave out boxes of candidates, against building and exchanges on a whole matrix."""

import numpy as np
import pytest

from siftpool.operators import samplers
from siftpool.operators.distance import Affine, Gower
from siftpool.operators.samplers import KMedoids
from siftpool.space import Space, p_dbl, p_fct
from tests.test_medoids import plain_pam

BOX = Space((p_dbl("a", 0, 1), p_dbl("b", 0, 1)))
MIXED = Space((p_dbl("a", 0, 1), p_fct("c", ["u", "v", "w"])))


@pytest.mark.parametrize("mixed", [False, True])
def test_boxes_leave_out_no_medoid(spark, monkeypatch, mixed):
    monkeypatch.setattr(samplers, "NEAR", 10, raising=False)
    monkeypatch.setattr(samplers, "CELLS", 8, raising=False)
    met, summed = [], KMedoids._summed

    def seen(self, cands, *args):
        met.append(cands.count())
        return summed(self, cands, *args)

    monkeypatch.setattr(KMedoids, "_summed", seen)
    rng = np.random.default_rng(7)
    if mixed:
        rows = sorted({(None if rng.random() < 0.1 else round(float(rng.random()), 3), None if rng.random() < 0.1 else str(rng.choice(["u", "v", "w"]))) for _ in range(70)} - {(None, None)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        pool, space, dist = spark.createDataFrame(rows, "a double, c string"), MIXED, Gower()
        told = [r[0] for r in rows if r[0] is not None]

        def apart(x, y):
            parts = ([abs(x[0] - y[0]) / (max(told) - min(told))] if None not in (x[0], y[0]) else []) + ([float(x[1] != y[1])] if None not in (x[1], y[1]) else [])
            return sum(parts) / len(parts) if parts else 0.0

        d = np.array([[apart(x, y) for y in rows] for x in rows])
    else:
        x = np.unique(np.round(np.concatenate([rng.normal(c, 0.1, (25, 2)) for c in ([0, 0], [0, 1], [1, 0.4])]), 3), axis=0)
        rows = [tuple(map(float, p)) for p in x]
        pool, space, dist = spark.createDataFrame(rows, "a double, b double"), BOX, Affine()
        z = x / (np.ptp(x, axis=0) / 2)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    got = {tuple(r) for r in KMedoids(dist).sample(3, space, pool.repartition(3)).collect()}
    picked, _ = plain_pam(d, 3, list(range(len(rows))), [])
    assert got == {rows[j] for j in picked}
    assert max(met) <= 8
