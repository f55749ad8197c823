import random

import pytest
from pyspark.sql import functions as F

from siftpool.operators.design import axis
from siftpool.operators.extent import nearest_on_axis, occupancy, spanned
from siftpool.space import Needs, Space, SpaceError, p_dbl, p_fct, p_int

SCHEMA = "x double, k int, name string, on boolean"


def test_spanned(spark):
    rows = spark.createDataFrame([(1.0, 3, "b", True), (float("nan"), None, "a", None), (4.5, 9, None, False), (None, 5, "b", True)], SCHEMA)
    x, k, name, on = spanned(rows, ["x", "k", "name", "on"]).params
    assert (x.kind, x.lower, x.upper) == ("dbl", 1.0, 4.5) and (k.kind, k.lower, k.upper) == ("int", 3, 9)
    assert name.levels == ("a", "b") and on.kind == "lgl"
    assert spanned(rows, ["name", "x"], (Needs("x", "name", ("a",)),)).order() == ["name", "x"]
    for df, ids, said in ((rows, ["name"], "more than 1 levels"), (rows.limit(0), ["x"], "no value"), (rows.where("k = 9"), ["name"], "no levels"), (rows.select(F.array("x").alias("x")), ["x"], "no parameter")):
        with pytest.raises(SpaceError, match=said):
            spanned(df, ids, levels=1)


def test_nearest_on_axis(spark):
    rows = spark.createDataFrame([(v,) for v in (-9.0, 0.0, 0.5, 0.51, 1.5, 99.0, float("nan"), None)], "x double")
    got = [r[0] for r in rows.select(nearest_on_axis(F.col("x"), [0.0, 1.0, 2.0])).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 1.0, 2.0, None, None]
    assert [r[0] for r in rows.select(nearest_on_axis(F.col("x"), [7.0])).collect()] == [7.0] * 6 + [None] * 2


def test_occupancy_is_a_plain_count(spark):
    draw = random.Random(4)
    space = Space((p_fct("name", ["a", "b", "c"]), p_dbl("x", -2, 6), p_int("k", 1, 9)), (Needs("x", "name", ("a", "b")), Needs("k", "name", ("b",))))
    rows = [(draw.uniform(-3, 7), draw.randint(0, 12), draw.choice("aaaabc"), None) for _ in range(400)]
    odd = [(None, 2, "a", None), (1.0, None, "b", None), (1.0, 1, "other", None), (1.0, 1, None, None), (None, None, "c", True)]
    got = {r[:3]: r[3] for r in map(tuple, occupancy(spark.createDataFrame(rows + odd, SCHEMA), space, 4).collect())}
    near = lambda v, a: min(a, key=lambda t: (abs(t - v), t))
    want = {("c", None, None): 0} | {("a", x, None): 0 for x in axis(space, "x", 4)} | {("b", x, k): 0 for x in axis(space, "x", 4) for k in axis(space, "k", 4)}
    for x, k, name, _ in [*rows, odd[4]]:
        want[name, near(x, axis(space, "x", 4)) if name in "ab" else None, near(k, axis(space, "k", 4)) if name == "b" else None] += 1
    assert got == want
    assert occupancy(spark.createDataFrame([], SCHEMA), space, 2).agg(F.sum("n_rows"), F.count("*")).first() == (0, 7)
    with pytest.raises(SpaceError, match="upper_limit"):
        occupancy(spark.createDataFrame(rows, SCHEMA), space, 4, limit=5)
