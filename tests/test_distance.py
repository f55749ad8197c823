import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.operators.distance import Affine, DistanceError, Gower, Standardize, distance
from siftpool.space import Space, p_dbl, p_fct, p_int


def pairs(spark, dist, refs, query, schema):
    names = [x.split()[0] for x in schema.split(",")]
    r = spark.createDataFrame([(*x, k) for k, x in enumerate(refs)], f"{schema}, k int")
    q = spark.createDataFrame(query, schema)
    rows = dist.set_references(r, ("k",)).pairs(q, {"k": "k"}).orderBy(*names, "k").collect()
    return [x.distance for x in rows]


def test_standardize_zero_variance(spark):
    space, schema = Space((p_dbl("x", 0, 2), p_dbl("y", 10, 10))), "x double, y double"
    rows = [(0.0, 10.0), (1.0, 10.0), (2.0, 10.0)]
    d = Standardize().fit(spark.createDataFrame(rows, schema), space)
    assert pairs(spark, d, [rows[0], rows[2]], [rows[1]], schema) == pytest.approx([1, 1])
    assert d.dimension == 2


def test_standardize_levels_and_nulls(spark):
    space, schema = Space((p_dbl("x", 0, 3), p_fct("color", ["red", "blue", "green"]))), "x double, color string"
    rows = [(1.0, "red"), (2.0, "blue"), (3.0, None), (2.0, "red")]
    d = Standardize().fit(spark.createDataFrame(rows, schema), space)
    got = pairs(spark, d, rows, [(1.0, "red"), (2.0, "green")], schema)
    assert got[0] == 0 and all(math.isfinite(x) for x in got) and d.dimension == 4


def test_standardize_bounds(spark):
    space = Space((p_dbl("x", 0, 10), p_fct("color", ["red", "blue"])))
    d = Standardize().fit(None, space)
    assert pairs(spark, d, [(0.0, "red"), (10.0, "blue")], [(5.0, "red")], "x double, color string")[0] == pytest.approx(math.sqrt(3), abs=1e-12)
    assert d.stats[0][2:] == (5.0, 10 / math.sqrt(12))


def test_affine(spark):
    space, schema = Space((p_dbl("x", 0, 10), p_int("y", 5, 5))), "x double, y int"
    rows = [(0.0, 5), (5.0, 5), (10.0, 5)]
    for pool in (spark.createDataFrame(rows, schema), None):
        assert pairs(spark, Affine().fit(pool, space), [rows[0], rows[2]], [rows[1]], schema) == pytest.approx([1, 1])
    with pytest.raises(DistanceError, match="numeric"):
        Affine().fit(None, Space((p_fct("color", ["a"]),)))
    with pytest.raises(DistanceError, match="is not fitted"):
        Affine().set_references(spark.createDataFrame(rows, schema))
    with pytest.raises(DistanceError, match="has no reference points"):
        Affine().fit(None, space).nearest(spark.createDataFrame(rows, schema))


def test_gower(spark):
    space, schema = Space((p_dbl("x", 0, 10), p_fct("color", ["red", "blue"]))), "x double, color string"
    pool = [(0.0, "red"), (10.0, "blue")]
    assert pairs(spark, Gower().fit(spark.createDataFrame(pool, schema), space), pool, [(5.0, "red")], schema) == pytest.approx([0.25, 0.75])
    wide = Space((p_dbl("x", 0, 20), p_fct("color", ["red", "blue"])))
    assert pairs(spark, Gower().fit(None, wide), pool, [(5.0, "red")], schema) == pytest.approx([0.125, 0.625])
    for mode in ("minmax_empirical", "standardize"):
        with pytest.raises(DistanceError, match="needs a pool"):
            Gower(mode).fit(None, wide)
    holes = [(0.0, None), (10.0, "blue")]
    assert pairs(spark, Gower().fit(spark.createDataFrame(holes, schema), space), holes, [(0.0, "red")], schema) == pytest.approx([0, 1])


@pytest.mark.parametrize("mode, want", [("minmax_empirical", 0.5), ("minmax_space", 0.25), ("standardize", 5 / (10 / math.sqrt(2))), ("off", 5)])
def test_gower_modes(spark, mode, want):
    pool = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    got = pairs(spark, Gower(mode).fit(pool, Space((p_dbl("x", 0, 20),))), [(0.0,), (10.0,)], [(5.0,)], "x double")
    assert got == pytest.approx([want, want])


def test_registry():
    assert distance("gower", scale="off").scale == "off"
    with pytest.raises(DistanceError, match="no distance"):
        distance("none")


def test_many_references_fold_in_blocks(spark, monkeypatch):
    import siftpool.functions.frames as frames

    monkeypatch.setattr(frames, "REFERENCES", 3)
    refs = spark.createDataFrame([(float(i * 10),) for i in range(11)], "x double")
    q = spark.createDataFrame([(3.0,), (58.0,), (250.0,)], "x double")
    got = Gower("off").fit(None, Space((p_dbl("x", 0, 300),))).set_references(refs).nearest(q).orderBy("x").collect()
    assert [r.distance for r in got] == [3, 2, 150]


def test_pairs_of_one_partition_are_dealt_to_many_tasks(spark, monkeypatch):
    """A small table is one partition; its pairs grow with the square, and were one task."""
    from siftpool.operators import distance as module

    monkeypatch.setattr(module, "PAIRS", 300)
    rows = spark.range(60).select("id", (F.col("id") * 1.5).alias("x")).coalesce(1)
    got = Affine().fit(rows, Space((p_dbl("x"),))).set_references(rows, ("id",)).pairs(rows, {"id": "other"}).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.id, r.other): round(r.distance, 9) for r in got} == {(i, j): round(abs(i - j) * 2 / 59, 9) for i in range(60) for j in range(60)} and len(got) == 3600
    assert len({r.task for r in got}) >= 10


SUPPLIERS = Space((p_dbl("s_acctbal"), p_int("s_nationkey")))


@pytest.mark.parametrize("dist", [Affine, Standardize, Gower])
def test_files_of_all_pairs_hold_equal_distances_once(spark, tmp_path, dist):
    """Each reference of a long array was its own value in the file, some 4 bytes a pair."""
    of = lambda n: spark.range(n).select("id", ((F.col("id") * 37 % 100) * 1.25).alias("s_acctbal"), (F.col("id") % 20).cast("int").alias("s_nationkey"))
    d = dist().fit(of(20_000), SUPPLIERS).set_references(of(20_000), ("id",))
    d.pairs(of(200), {"id": "other"}).select("id", "other", "distance").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("id", "other").distinct().count() == 4_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 4_000_000
    one = of(1).drop("id").first()
    at = {c: F.lit(one[c]) for c in one.__fields__}
    want = {r.id: r.d for r in of(20_000).select("id", d.between(at).alias("d")).collect()}
    assert {r.other: r.distance for r in got.where("id = 0").collect()} == want


@pytest.mark.parametrize("dist", [Affine, Standardize, Gower])
def test_pairs_of_repeated_and_odd_values(spark, monkeypatch, dist):
    from siftpool.operators import distance as module

    monkeypatch.setattr(module, "BLOCK", 7, raising=False)
    monkeypatch.setattr(module, "PAIRS", 400)
    nan = float("nan")
    rows = [(i % 30, x, n, {"k": i}) for i, (x, n) in enumerate([(0.0, 1), (-0.0, 1), (None, 2), (2.5, None), (nan, 3), (4.0, 5), (None, None)] * 9)]  # ids come twice, some with the same values
    df = spark.createDataFrame(rows, "id int, s_acctbal double, s_nationkey int, more map<string, int>").repartition(3)
    d = dist().fit(df.where("NOT isnan(s_acctbal)"), SUPPLIERS).set_references(df.where("id < 20"), ("id",))
    told = lambda frame: sorted(repr((r.id, r.s_acctbal, r.s_nationkey, r.more, r.other, r.distance)) for r in frame.collect())
    plain = df.crossJoin(d.references.select(F.struct("*").alias("ref"))).select(*df.columns, F.col("ref.id").alias("other"), d.between(F.col("ref")).alias("distance"))
    got = told(d.pairs(df, {"id": "other"}))
    assert got == told(plain) and len(got) == 63 * df.where("id < 20").count()
    assert told(d.pairs(df.limit(0), {"id": "other"})) == []
    assert told(d.set_references(df.limit(0), ("id",)).pairs(df, {"id": "other"})) == []


def test_six_places_are_those_of_sql(spark):
    from siftpool.queries import _six

    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    x = [*(rng.random(3000) * 3), *(rng.integers(0, 4_000_000, 3000) / 2e6), *(10.0 ** rng.integers(-9, 12, 300) * rng.random(300)), 0.0, 0.0000005, 1.0000015, 0.49999949999999997]
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", _six(F.col("x")).alias("y")).orderBy("i").collect()
    want = duckdb.sql(f"SELECT round(v, 6) FROM (SELECT unnest({[float(v) for v in x]!r}::DOUBLE[]) v)").fetchall()
    assert [r.y for r in got] == [w[0] for w in want]
    odd = spark.createDataFrame([(float("nan"),), (None,), (math.inf,), (1.5e305,)], "x double").select(_six(F.col("x")).alias("y")).collect()
    assert math.isnan(odd[0].y) and odd[1].y is None and odd[2].y == math.inf and odd[3].y == 1.5e305
