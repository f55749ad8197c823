import pytest
from pyspark.sql import functions as F

from siftpool.operators.design import grid, grid_size, lhs_design, random_design, sobol_design
from siftpool.space import Codomain, Needs, Space, SpaceError, p_dbl, p_fct, p_int, p_lgl, p_uty

GATE = Space((p_lgl("gate"), p_int("x", 1, 3)), (Needs("x", "gate", (True,)),))


def test_grids(spark):
    assert grid(spark, Space((p_dbl("x", 0, 1), p_fct("y", ["a", "b", "c"]))), 4).count() == 12
    assert sorted(map(tuple, grid(spark, GATE, 3).collect()), key=str) == [(False, None), (True, 1), (True, 2), (True, 3)]
    assert grid(spark, Space(tuple(p_int(f"i{k}", 0, 1) for k in range(6))), 100).count() == 64
    ids = [f"i{k}" for k in range(8)]
    chain = Space(tuple(p_int(i, 1, 10) for i in ids), tuple(Needs(b, a, (1,)) for a, b in zip(ids, ids[1:])))
    assert grid(spark, chain, 10).count() == 73 == grid_size(chain, 10)
    with pytest.raises(SpaceError, match="upper_limit"):
        grid(spark, Space(tuple(p_dbl(f"d{k}", 0, 1) for k in range(5))), 10, limit=99_999)
    with pytest.raises(SpaceError, match="cycle"):
        grid(spark, Space((p_lgl("a"), p_lgl("b")), (Needs("a", "b", (True,)), Needs("b", "a", (True,)))), 2)
    with pytest.raises(SpaceError, match="resolutions are missing"):
        grid(spark, Space((p_dbl("x", 0, 1),)))


def test_pool_candidates(spark):
    rows = lambda data, schema, space: sorted(map(tuple, space.pool_candidates(spark.createDataFrame(data, schema)).collect()), key=str)
    assert rows([(1,), (10,)], "x int", Space((p_int("x", 1, 3, special=(10,)),))) == [(1,), (10,)]
    assert rows([(1.0,), (1.5,), (2.0,), (2.5,), (3.0,)], "x double", Space((p_int("x", 1, 3),))) == [(1.0,), (2.0,), (3.0,)]
    limited = Space((p_int("x1", 0, 2), p_int("x2", 0, 2)), constraint=lambda df: F.col("x1") + F.col("x2") <= 1)
    assert rows([(a, b) for a in range(3) for b in range(3)], "x1 int, x2 int", limited) == [(0, 0), (0, 1), (1, 0)]
    fixed = Space(GATE.params, GATE.deps, {"gate": False})
    assert rows([(False, None), (True, 1), (True, 2)], "gate boolean, x int", fixed) == [(False, None)]
    assert len(rows([(x, y) for x in range(1, 6) for y in "abc"], "x int, y string", Space((p_int("x", 2, 3), p_fct("y", ["a", "b"]))))) == 4
    assert rows([(0,), (1,)], "x int", Space((p_lgl("x"),))) == []


def test_assert_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    space = Space((p_int("x", 1, 3), p_fct("y", ["a", "b"])))
    assert space.assert_table(df).count() == 2
    for bad, said in ((df.drop("y"), "missing"), (df.withColumn("x", F.lit(9)), "bounds"), (df.union(df), "duplicate"), (df.limit(0), "at least"), (df.withColumn("x", F.col("y")), "not int")):
        with pytest.raises(SpaceError, match=said):
            space.assert_table(bad)
    with pytest.raises(SpaceError, match="extra"):
        space.assert_table(df.withColumn("z", F.lit(1)), extra=False)
    with pytest.raises(SpaceError, match="gate == TRUE"):
        GATE.assert_table(spark.createDataFrame([(False, 2)], "gate boolean, x int"))
    with pytest.raises(SpaceError, match="no numbers"):
        Space((p_uty("u", lambda v: v.isalpha() or "no numbers"),)).assert_table(spark.createDataFrame([("a1",)], "u string"))
    assert space.assert_table(df.drop("y"), subset=True).columns == ["x", "y"]


def test_designs(spark):
    space = Space((p_dbl("x", 0, 2), p_int("k", 1, 4), p_fct("c", ["a", "b"]), p_lgl("l")))
    for made in (random_design(spark, space, 50), lhs_design(spark, space, 50), sobol_design(spark, space, 50)):
        assert made.count() == 50 and made.where(~space.valid(made)).isEmpty()
    slots = lhs_design(spark, Space((p_dbl("x", 0, 1), p_dbl("y", 0, 1))), 40).select(F.floor(F.col("x") * 40).alias("x"), F.floor(F.col("y") * 40).alias("y"))
    assert all(slots.select(c).distinct().count() == 40 for c in ("x", "y"))
    first = sobol_design(spark, Space((p_dbl("x", 0, 1), p_dbl("y", 0, 1), p_dbl("z", 0, 1))), 3).collect()
    assert {tuple(r) for r in first} == {(0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75)}  # as published


def test_volume_and_codomain():
    assert Space((p_dbl("x", 0, 2), p_int("k", 1, 4), p_fct("c", list("abc")), p_lgl("l"))).volume() == 2 * 3 * 3 * 2
    with pytest.raises(SpaceError):
        Space((p_dbl("x"),)).volume()
    out = Codomain({"y": "maximize", "note": None})
    assert (out.targets, out.goals, out.sign()) == (["y"], ["maximize"], 1)
    with pytest.raises(SpaceError):
        Codomain({"note": None})


def test_latin_hypercube_slots_are_independent_permutations(spark):
    space = Space(tuple(p_dbl(f"x{k}", 0, 1) for k in range(3)))
    for n in (0, 1, 2, 37, 257):
        slots = lhs_design(spark, space, n, seed=4).select(*(F.floor(F.col(f"x{k}") * n).alias(f"x{k}") for k in range(3))).collect()
        assert all(sorted(r[k] for r in slots) == list(range(n)) for k in range(3))
    steps = {(b.x0 - a.x0) % 257 for a, b in zip(slots, slots[1:])}
    assert len(steps) > 50 and len({r.x0 == r.x1 for r in slots}) == 2  # no lattice
    again, other = (lhs_design(spark, space, 257, seed=s).collect() for s in (4, 5))
    assert again == lhs_design(spark, space, 257, seed=4).collect() != other


def test_sobol_of_many_parameters(spark):
    space = Space(tuple(p_dbl(f"x{k}", 0, 1) for k in range(24)))
    rows = sobol_design(spark, space, 64, skip=64).collect()
    for k in range(24):
        assert sorted(int(r[k] * 64) for r in rows) == list(range(64))
    assert len({tuple(r[k] for r in rows) for k in range(24)}) == 24
