"""Variances of a model over a table follow from one prediction."""

from pyspark.sql import functions as F

from siftpool.functions import metrics as M
from siftpool.space import Space, p_dbl


def test_one_prediction_for_all_variances(spark):
    class Model:
        asked = 0

        def predict(self, rows):
            self.asked += 1
            return rows.withColumn("se", F.col("x"))

    model, rows, space = Model(), spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), Space((p_dbl("x", 0, 4),))
    got = M.variances(rows, model, space, rows)
    assert model.asked == 1
    assert got == (M.mean_variance(rows, model, rows), M.max_variance(rows, model, rows), M.integrated_variance(rows, model, space, rows))
