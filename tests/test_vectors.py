"""Nearest vectors by products of matrices against plain differences."""

import numpy as np

from siftpool.operators import vectors


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "REFS", 5)
    monkeypatch.setattr(vectors, "squared_distance", None)  # not one expression for each pair
    rng = np.random.default_rng(3)
    refs = rng.normal(1000, 1, (40, 6)).astype(np.float32)
    x = np.concatenate([rng.normal(1000, 1, (30, 6)), refs[:8] + 1e-4, refs[8:12]]).astype(np.float32)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None]), (92, [3.0, 4.0]), (93, [float("nan"), 0.0]), (94, [1.0]), (95, [])]
    told = [(list(map(float, v)),) for v in [*refs, refs[0]]] + [(None,), ([0.0, 0.0],), ([None, 4.0],)]
    got = {r.id: r.distance for r in vectors.nearest_vector(spark.createDataFrame(rows, "id int, v array<float>").repartition(3), spark.createDataFrame(told, "v array<float>"), "v").collect()}
    assert len(got) == len(rows)
    for i, v in enumerate(x.astype(float)):
        assert np.isclose(got[i], np.sqrt(((v - refs) ** 2).sum(axis=1).min()), rtol=1e-12, atol=0)
    assert got[92] == 5 and np.isnan(got[93]) and [got[k] for k in (90, 91, 94, 95)] == [None] * 4
