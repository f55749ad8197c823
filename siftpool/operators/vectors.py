"""Distances between array columns, for pools whose rows are embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import checkpointed
from siftpool.operators.nearest import tasks

ROWS, REFS = 1024, 4096  # rows and references of a block at most


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def least_squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the nearest row of y, NaN last.

    A product of matrices tells, but for rounding, which can be the nearest;
    those are compared by their differences. What is not finite is all compared so.
    """
    out = np.full(len(x), np.nan)
    sound, told = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
    with np.errstate(all="ignore"):
        for i in np.flatnonzero(~sound):
            out[i] = np.fmin.reduce(((x[i] - y) ** 2).sum(axis=1))
        for j in np.flatnonzero(~told):
            out = np.fmin(out, ((x - y[j]) ** 2).sum(axis=1))
        rows, refs = np.flatnonzero(sound), y[told]
        if not len(rows) or not len(refs):
            return out
        own, norms, other = x[rows], (x[rows] ** 2).sum(axis=1), (refs**2).sum(axis=1)
        about = norms[:, None] + other - 2 * (own @ refs.T)
        slack = 1e-14 * (x.shape[1] + 8) * (norms + other.max())
        near = ~(about > (about.min(axis=1) + 2 * slack)[:, None])
    i, j = np.nonzero(near)
    best = np.full(len(own), np.inf)
    for a in range(0, len(i), 1 << 16):
        at = slice(a, a + (1 << 16))
        np.minimum.at(best, i[at], ((own[i[at]] - refs[j[at]]) ** 2).sum(axis=1))
    out[rows] = np.fmin(out[rows], best)
    return out


def _blocks(vectors: DataFrame, size: int, names: list[str]) -> DataFrame:
    """Blocks of size vectors at most of equal width: rows (width, ids, values) under those names, from rows (id, v), written once."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            flat, widths = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy()
            ends, ids = np.cumsum(widths), batch.column("id").to_numpy()
            for width in map(int, np.unique(widths)):
                every = np.flatnonzero(widths == width)
                for a in range(0, len(every), size):
                    at = every[a : a + size]
                    x = flat[(ends[at] - width)[:, None] + np.arange(width)]
                    yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([ids[at].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names)

    return checkpointed(vectors.mapInArrow(run, f"{names[0]} bigint, {names[1]} binary, {names[2]} binary"))


def nearest_vector(rows: DataFrame, refs: DataFrame, vector: str, out: str = "distance") -> DataFrame:
    """Euclidean distance of each row's array to the nearest of the references'; null for arrays that are null, empty, hold nulls or find none of their length.

    Blocks of rows meet blocks of distinct references, each pair in a task as a
    product of matrices; nothing of them passes through the driver.
    """
    v = F.col(vector).cast("array<double>").alias("v")
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0)
    rows = checkpointed(rows.withColumn("row__", F.monotonically_increasing_id()))
    own = _blocks(rows.select(F.col("row__").alias("id"), v).where(whole), ROWS, ["width", "ids", "x"]).repartition(tasks(rows))
    met = _blocks(refs.select(v).where(whole).distinct().select(F.lit(0).cast("bigint").alias("id"), "v"), REFS, ["ref_width", "none", "y"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                if batch.column("ref_width")[i].as_py() == width:
                    x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, width) for c in "xy")
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)), pa.array(least_squared(x, y))], ["row__", "least__"])

    pairs = own.crossJoin(met.drop("none").coalesce(4)).mapInArrow(run, "row__ bigint, least__ double")
    least = pairs.groupBy("row__").agg(F.sqrt(F.min("least__")).alias(out))
    return rows.join(least, "row__", "left").drop("row__")
