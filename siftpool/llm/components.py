"""Connected components as joins and aggregations; no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import forget, written


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Rows (node, component): the smallest node that each node of an edge can reach.

    Alternates the large-star and small-star steps, which keep connectivity and
    turn any graph into stars after a number of rounds that grows with the
    logarithm of its size. Each step is one aggregation (with partial sums, so a
    hub costs one row per task) and one join, which Spark may split for skew.
    Rounds are written to the shared folder. Edges with a null end, loops and
    edges that repeat add nothing; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    now = written(now, name)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)  # read again, a join with a hub's many edges can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        last, now = now, written(small, name)
        forget(last)
        forget(least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour or only larger ones; edges are rows (u, v) with u > v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") > 1) | (F.col("up") * F.col("down") > 0))).first()[0]
