import itertools

import pytest

from siftpool.operators.samplers import SamplerError, sampler, stage_sizes
from siftpool.space import Space, p_dbl, p_lgl

X = Space((p_dbl("x", 0, 10),))


def pick(spark, s, xs, n, known=None):
    df = lambda v: spark.createDataFrame([(float(a),) for a in v], "x double")
    return sorted(r.x for r in s.sample(n, X, df(xs), None if known is None else df(known)).collect())


def test_contract(spark):
    for n in (2, 3):
        assert pick(spark, sampler("uniform"), [0.1, 0.9], n) == [0.1, 0.9]
    for key in ("lhs", "sobol"):
        with pytest.raises(SamplerError, match="does not support 'pool'"):
            pick(spark, sampler(key), [0.1, 0.9], 1)
        assert sampler(key).sample(7, X, spark=spark).count() == 7
    for key in ("gsx", "kmeans", "relational_kmeans", "kmedoids"):
        with pytest.raises(SamplerError, match="requires a pool"):
            sampler(key).sample(1, X, spark=spark)
    assert sampler("uniform").deterministic and not sampler("gsx").deterministic


def test_gsx(spark):
    assert pick(spark, sampler("gsx"), [0, 2, 5, 8, 10], 3) == [0, 5, 10]
    assert pick(spark, sampler("gsx"), [0, 2, 8, 10], 2, [5]) == [0, 10]
    assert len(set(pick(spark, sampler("gsx"), range(30), 12))) == 12


def test_kmeans(spark):
    assert pick(spark, sampler("kmeans"), [0, 5, 10], 1) == [5]
    assert pick(spark, sampler("kmeans"), [0, 10], 1, [10]) == [10]
    space = Space((p_dbl("x", 0, 10), p_dbl("y", 0, 10)))
    pool = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (9.0, 10.0), (10.0, 9.0), (10.0, 10.0)], "x double, y double")
    got = [sorted(map(tuple, sampler(k, starts=3).sample(2, space, pool).collect())) for k in ("kmeans", "relational_kmeans")]
    assert got[0] == got[1] == [(0.0, 0.0), (10.0, 10.0)]


def test_relational_kmeans_moves_all_starts_in_one_job(spark):
    """Steps of each start by itself are as many small jobs as there are starts, times the steps."""
    rows = spark.createDataFrame([((37.0 * i) % 101 / 10.1,) for i in range(101)], "x double").repartition(2).localCheckpoint()
    jobs = []
    for starts in (2, 10):
        spark.sparkContext.setJobGroup(f"starts{starts}", "")
        assert len(sampler("relational_kmeans", starts=starts).sample(4, X, rows).collect()) == 4
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts{starts}")))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs[1] - jobs[0] < 60, jobs


def test_relational_kmeans_on_mixed_columns(spark):
    """The best of all partitions into two, by brute force; known rows count but are not picked."""
    space = Space((p_dbl("x", 0, 10), p_lgl("flag")))
    rows = [(0.0, False), (1.0, False), (2.5, False), (3.0, True), (8.0, True), (9.0, True), (10.0, True), (7.5, None)]
    known = [(9.5, True)]
    frame = lambda r: spark.createDataFrame(r, "x double, flag boolean")

    def squared(a, b):
        parts = [abs(a[0] - b[0]) / 10] + ([float(a[1] != b[1])] if a[1] is not None and b[1] is not None else [])
        return (sum(parts) / len(parts)) ** 2

    for more in ([], known):
        every = rows + more

        def apart(x, group):
            return sum(squared(x, y) for y in group) / len(group) - sum(squared(y, z) for y in group for z in group) / (2 * len(group) ** 2)

        splits = []
        for mask in range(1, 2 ** (len(every) - 1)):
            groups = [[r for i, r in enumerate(every) if (mask >> i & 1) == k] for k in (0, 1)]
            splits.append((sum(apart(x, g) for g in groups for x in g), groups))
        groups = min(splits, key=lambda s: s[0])[1]
        want = sorted(min(rows, key=lambda x: apart(x, g)) for g in groups)
        got = sampler("relational_kmeans", dist="gower").sample(2, space, frame(rows), frame(more) if more else None).collect()
        assert sorted(map(tuple, got)) == want


def test_relational_kmeans_repairs_lost_clusters(spark):
    own = sampler("relational_kmeans", dist="gower")
    rows = spark.createDataFrame([(0, [0], [0.0, 9.0]), (1, [0], [4.0, 9.0]), (2, [0], [1.0, 9.0])], "row__ long, new__ array<int>, sums__ array<double>")
    from pyspark.sql import functions as F

    got = own._repaired(rows, [F.col("sums__")[0], F.lit(float("inf"))], 0, 2).orderBy("row__").collect()
    assert [r["new__"] for r in got] == [[0], [1], [0]]


def test_kmedoids(spark):
    assert pick(spark, sampler("kmedoids", dist="affine"), [0, 1, 2, 8, 9, 10], 2) == [1, 9]
    assert pick(spark, sampler("kmedoids", dist="affine"), [0, 1, 2, 8, 9, 10], 1, [0.5]) == [9]
    space = Space((p_dbl("x", 0, 10), p_lgl("flag")))
    pool = spark.createDataFrame([(0.0, False), (1.0, False), (10.0, True)], "x double, flag boolean")
    assert sampler("kmedoids").sample(1, space, pool).first().x == 1
    xs = [0, 1.5, 2, 3.5, 7, 8, 9.5]
    cost = lambda m: sum(min(abs(x - y) for y in m) for x in xs)
    got = pick(spark, sampler("kmedoids", dist="affine"), xs, 3)
    assert cost(got) == pytest.approx(min(map(cost, itertools.combinations(xs, 3))))


def test_chain_and_conditional(spark):
    assert stage_sizes(100, 5, 3) == [37, 14, 5] and stage_sizes(None, 5, 3) == [20, 10, 5]
    both = sampler("chain", samplers=[sampler("uniform"), sampler("gsx")])
    assert len(pick(spark, both, range(40), 4)) == 4
    cond = sampler("conditional", with_pool=sampler("gsx"), without_pool=sampler("lhs"))
    assert pick(spark, cond, [0, 2, 5, 8, 10], 3) == [0, 5, 10] and cond.sample(6, X, spark=spark).count() == 6
    with pytest.raises(SamplerError, match="must not grow"):
        pick(spark, sampler("chain", samplers=[sampler("gsx")], sizes=lambda size, n: [n + 1]), range(9), 2)
