"""Sums over clusters' profiles against all distances, and relational k-means by both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.functions import frames
from siftpool.operators import profiles, samplers
from siftpool.operators.distance import Gower
from siftpool.operators.samplers import sampler
from siftpool.space import Space, p_dbl, p_fct, p_int, p_lgl

SPACES = {
    "mixed": Space((p_dbl("a", 0, 1), p_int("b", 0, 9), p_fct("c", ["u", "v", "w"]), p_lgl("l"))),
    "numbers": Space((p_dbl("a", 0, 1), p_int("b", 0, 9), p_dbl("e", 0, 5))),
    "factors": Space((p_fct("c", ["u", "v", "w"]), p_lgl("l"))),
    "one": Space((p_int("b", 0, 9),)),
    "flat": Space((p_dbl("a", 0, 1), p_dbl("k", 0, 1), p_fct("c", ["u", "v", "w"]))),
}


def drawn(seed, count, nulls):
    rng = np.random.default_rng(seed)
    gone = lambda v: None if rng.random() < nulls else v
    hot = lambda v, w: w if rng.random() < 1 / 3 else v  # noqa: E731  a third of all rows share a value
    return [
        (gone(hot(float(rng.random()), 0.25)), gone(int(rng.integers(10))), gone(hot(float(rng.exponential()), 0.0)), gone(str(rng.choice(["u", "v", "w"]))), gone(bool(rng.integers(2))), 0.5)
        for _ in range(count)
    ]


@pytest.mark.parametrize("name", list(SPACES))
@pytest.mark.parametrize("nulls", [0.0, 0.2])
def test_sums_are_those_of_all_distances(spark, monkeypatch, name, nulls):
    monkeypatch.setattr(profiles, "STRIP", 16)
    space, n, starts = SPACES[name], 3, 2
    rows = spark.createDataFrame(drawn(len(name), 150, nulls), "a double, b int, e double, c string, l boolean, k double").withColumn("row__", F.monotonically_increasing_id())
    rows = frames.checkpointed(rows)
    d = Gower().fit(rows, space)
    own = profiles.GowerProfiles(rows, d)
    assert own.fits(n * starts) and own.strips > 5
    told = frames.checkpointed(own.rows.withColumn("labels__", F.array(F.pmod(F.xxhash64("row__"), F.lit(n)).cast("int"), F.when(F.col("row__") % 5 == 0, 0).otherwise(2))))
    got = {r["row__"]: r["sums__"] for r in own.sums(told, n, starts).collect()}
    want = {r["row__"]: r["sums__"] for r in samplers.RelationalKMeans._sums(told, d, n, starts).collect()}
    assert len(got) == len(want) == 150
    every = told.select("row__", "labels__", *space.ids).collect()

    def squared(x, y):
        parts = []
        for p in space.params:
            if (p.numeric and d.spread[p.id] <= 0) or x[p.id] is None or y[p.id] is None:
                continue
            parts.append(abs(x[p.id] - y[p.id]) / d.spread[p.id] if p.numeric else float(x[p.id] != y[p.id]))
        return (sum(parts) / len(parts)) ** 2 if parts else 0.0

    for x in every:
        plain = [sum(squared(x, y) for y in every if y["labels__"][s] == k) for s in range(starts) for k in range(n)]
        assert got[x["row__"]] == pytest.approx(plain, abs=1e-9) and want[x["row__"]] == pytest.approx(plain, abs=1e-9)


def test_relational_kmeans_is_the_same_by_profiles(spark, monkeypatch):
    pool = spark.createDataFrame(drawn(7, 90, 0.1), "a double, b int, e double, c string, l boolean, k double")
    known = spark.createDataFrame(drawn(8, 10, 0.1), "a double, b int, e double, c string, l boolean, k double")
    pick = lambda: sampler("relational_kmeans", dist="gower", starts=2, steps=4).sample(3, SPACES["mixed"], pool, known).collect()
    want = pick()
    monkeypatch.setattr(frames, "REFERENCES", 20)
    monkeypatch.setattr(profiles, "STRIP", 32)
    assert pick() == want and len(want) == 3


def test_very_many_levels_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(frames, "REFERENCES", 20)
    monkeypatch.setattr(profiles, "TABLES", 10)
    pool = spark.createDataFrame(drawn(9, 40, 0.0), "a double, b int, e double, c string, l boolean, k double")
    assert sampler("relational_kmeans", dist="gower", starts=1, steps=2).sample(2, SPACES["factors"], pool).count() == 2


def test_steps_with_one_number_shuffle_no_row_and_are_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(frames, "REFERENCES", 20)
    monkeypatch.setattr(profiles, "STRIP", 16)
    space, n, starts = SPACES["flat"], 3, 2
    pool = spark.createDataFrame(drawn(11, 200, 0.2), "a double, b int, e double, c string, l boolean, k double")
    rows = frames.checkpointed(space.project(pool).withColumn("row__", F.monotonically_increasing_id()))
    own = profiles.GowerProfiles(rows, Gower().fit(rows, space))
    told = frames.checkpointed(own.rows.withColumn("labels__", F.array(F.lit(0), (F.col("row__") % 3).cast("int"))))
    assert told.rdd.getNumPartitions() == own.strips > 5
    assert "Exchange" not in own.sums(told, n, starts)._jdf.queryExecution().toString()

    def jobs(steps):
        group = f"steps {steps}"
        spark.sparkContext.setJobGroup(group, group)
        assert len(sampler("relational_kmeans", dist="gower", starts=starts, steps=steps).sample(n, space, pool).collect()) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        few, more = jobs(1), jobs(3)  # a shuffle may be a job of its own
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < more - few <= 2 * 5
