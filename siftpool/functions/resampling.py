"""Extension: splits for judging forecasts, as rows (fold, role) beside the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import seeded


def holdout(rows: DataFrame, ids: list[str], share: float = 2 / 3, seed: int = 1) -> DataFrame:
    """rows with role train or test, by a hash of their ids; about that share is for training."""
    place = F.conv(F.substring(seeded(seed, ids), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("role", F.when(place < share, "train").otherwise("test"))


def window_folds(rows: DataFrame, step: str, folds: int, horizon: int, window: int | None = None) -> DataFrame:
    """Each row once for each fold it belongs to, with fold and role.

    step numbers the rows' batches. Fold k tests on the horizon of steps that
    ends k horizons before the last step, and trains on all steps before them
    (expanding), or on the last window of those (rolling).
    """
    last = rows.agg(F.max(step)).first()[0]
    if last is None:
        return rows.withColumn("fold", F.lit(0)).withColumn("role", F.lit("train"))
    first = -math.inf
    told = []
    for k in range(folds):
        end = last - k * horizon
        begin = end - horizon + 1
        low = first if window is None else begin - window
        told.append(F.when(F.col(step).between(begin, end), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("role"))).when((F.col(step) < begin) & (F.col(step) >= F.lit(low)), F.struct(F.lit(k).alias("fold"), F.lit("train").alias("role"))))
    return rows.withColumn("told", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull()))).select(*rows.columns, "told.fold", "told.role")
