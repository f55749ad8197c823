"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCES = 20_000  # rows of one array of references at most, about


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder that spark.checkpoint.dir names, on one machine beside the warehouse if it is unset; cuts the lineage of a loop."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = os.path.join(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")), "checkpoints")
        sc.setCheckpointDir(named or own)
    return df.checkpoint()


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def same(left: DataFrame, right: DataFrame, ids: Iterable[str]) -> Column:
    """Null-safe equality on all ids."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in ids))


def anti(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of left whose ids are not in right; nulls match nulls."""
    r = right.select(ids).distinct().toDF(*(f"{c}__r" for c in ids))
    return left.join(r, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in ids)), "left_anti")


def semi(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of left whose ids are in right; nulls match nulls."""
    r = right.select(ids).distinct().toDF(*(f"{c}__r" for c in ids))
    return left.join(r, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in ids)), "left_semi")


def by_key(ids: Iterable[str]) -> list[Column]:
    """The order of a pool: ascending by its ids, nulls first."""
    return [F.asc_nulls_first(c) for c in ids]


def usable(score: Column) -> Column:
    """A score that can be ordered: NaN counts as null."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def top(df: DataFrame, score: str, n: int, ids: list[str]) -> DataFrame:
    """The n rows of the highest scores; null and NaN scores are left out, ties go by ids."""
    ranked = df.where(usable(F.col(score)).isNotNull())
    return ranked.orderBy(F.desc(score), *by_key(ids)).limit(n)


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join of two large frames that sends neither whole through the driver: checkpointed frames are thought as small as the compressed files that they came from, and would be broadcast."""
    return left.join(right.hint("merge"), key)


def seeded(seed: int | str, ids: Iterable[str]) -> Column:
    """A key that orders rows at random but the same everywhere: MD5 of the seed and the ids as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids)))


def arrays(df: DataFrame, cols: list[str]) -> Iterator[DataFrame]:
    """One-row frames (refs array<struct>) that together hold all rows of df, each with about REFERENCES rows at most.

    What is sent to the tasks at once stays bounded; a caller folds over the
    frames, each joined to all candidates.
    """
    n = max(1, math.ceil(df.count() / REFERENCES))
    own = df.select(*cols)
    for b in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64(*cols), F.lit(n)) == b)
        yield part.agg(F.collect_list(F.struct(*cols)).alias("refs"))


def beside(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Each row of df with the one row of refs."""
    return df.crossJoin(F.broadcast(refs))


def few(df: DataFrame, most: int | None = None) -> bool:
    """Whether df has REFERENCES rows at most (or so many, if fewer), so that it may be sent to all tasks at once."""
    n = REFERENCES if most is None else min(REFERENCES, most)
    return df.limit(n + 1).count() <= n


def block(df: DataFrame, cols: list[Column], order: list[Column]) -> np.ndarray:
    """The values of cols, cast to double (nulls as NaN), of all rows in that order; for a frame of few() rows."""
    rows = df.orderBy(*order).select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(cols))).toPandas()
    return rows.to_numpy(float).reshape(len(rows), len(cols))


def over_block(refs: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], cols: list[Column], spark: SparkSession, kind: str = "double") -> Column:
    """kernel(rows' values of cols, refs) in the tasks, for so many rows at a time that rows x refs stays bounded. It returns a value for each row, or a row of values for a struct."""
    sent, step = spark.sparkContext.broadcast(refs), max(1, (1 << 21) // max(1, len(refs)))

    def every(values: tuple[pd.Series, ...]) -> list[np.ndarray]:
        x = np.column_stack([v.to_numpy(float) for v in values])
        return [kernel(x[i : i + step], sent.value) for i in range(0, len(x), step)]

    def number(*values: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *every(values)]))

    def struct(*values: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in kind.split(", ")]
        return pd.DataFrame(np.concatenate([np.zeros((0, len(names))), *every(values)]), columns=names)

    return F.pandas_udf(number if kind == "double" else struct, kind)(*(c.cast("double") for c in cols))
