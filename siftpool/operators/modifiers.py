"""Changes to utilities while a batch is built, by what the batch already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.operators.distance import Gower
from siftpool.space import Space


class Modifier:
    def modify(self, cands: DataFrame, utility: str, selected: DataFrame | None, space: Space) -> DataFrame:
        """cands with the utility changed; selected holds the rows picked or pending."""
        return cands


def _near(cands: DataFrame, selected: DataFrame, space: Space) -> DataFrame:
    return Gower("minmax_space").fit(None, space).set_references(selected).nearest(cands, "near_selected")


class LocalPenalization(Modifier):
    """Candidates within a Gower distance of a selected row lose the penalty; an infinite one leaves -inf."""

    def __init__(self, bandwidth: float = 0.1, penalty: float = float("inf")):
        self.bandwidth, self.penalty = bandwidth, penalty

    def modify(self, cands, utility, selected, space):
        if selected is None or self.bandwidth == 0:
            return cands
        lower = F.lit(float("-inf")) if self.penalty == float("inf") else F.col(utility) - F.lit(float(self.penalty))
        return _near(cands, selected, space).withColumn(utility, F.when(F.col("near_selected") <= self.bandwidth, lower).otherwise(F.col(utility))).drop("near_selected")


class Diversity(Modifier):
    """(1 - weight) * utility + weight * distance to the nearest selected row, both put to [0, 1] over all candidates."""

    def __init__(self, weight: float = 0.5):
        self.weight = weight

    def modify(self, cands, utility, selected, space):
        if selected is None or self.weight == 0:
            return cands
        rows = _near(cands, selected, space)
        finite = F.when(F.abs(F.col(utility)) < float("inf"), F.nanvl(F.col(utility), F.lit(None).cast("double")))
        row = rows.agg(F.min(finite), F.max(finite), F.min("near_selected"), F.max("near_selected")).first()

        def scaled(col, lo, hi):
            return (col - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else col * 0.0

        mixed = F.lit(self.weight) * scaled(F.col("near_selected"), row[2], row[3])
        if self.weight < 1:
            mixed = F.when(finite.isNotNull(), mixed + F.lit(1 - self.weight) * scaled(finite, row[0], row[1])).otherwise(F.lit(float("-inf")))
        return rows.withColumn(utility, mixed).drop("near_selected")
