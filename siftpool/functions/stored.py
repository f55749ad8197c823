"""Fitted surrogates to and from a folder that all of the cluster can read."""

from __future__ import annotations

import pickle

from pyspark.sql import SparkSession

from siftpool.operators.surrogates import Bootstrap, Surrogate, Trees


def save_surrogate(model: Surrogate, path: str, spark: SparkSession) -> None:
    """A pickle in a one-row table; MLlib models inside go to folders of their own."""
    inner, outer = [], model
    if isinstance(model, Trees):
        inner, outer = [model], _without(model)
    elif isinstance(model, Bootstrap):
        inner = [m for m in model.models if isinstance(m, Trees)]
        outer = Bootstrap.__new__(Bootstrap)
        outer.__dict__ = {"base": None, "n": model.n, "seed": model.seed, "models": [_without(m) if isinstance(m, Trees) else m for m in model.models]}
    for k, m in enumerate(inner):
        m.model.write().overwrite().save(f"{path}/ml{k}")
    spark.createDataFrame([(bytearray(pickle.dumps(outer)), len(inner))], "model binary, inner int").write.mode("overwrite").parquet(f"{path}/state")


def _without(model: Trees) -> Trees:
    out = Trees(model.trees, model.depth, model.seed)
    out.embed = model.embed
    return out


def load_surrogate(path: str, spark: SparkSession) -> Surrogate:
    """What save_surrogate() stored; load only what you stored yourself, as with any pickle."""
    from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel

    row = spark.read.parquet(f"{path}/state").first()
    model = pickle.loads(bytes(row.model))
    own = [model] if isinstance(model, Trees) else [m for m in getattr(model, "models", []) if isinstance(m, Trees)]
    for k, m in enumerate(own[: row.inner]):
        m.model = (DecisionTreeRegressionModel if m.trees == 1 else RandomForestRegressionModel).load(f"{path}/ml{k}")
    return model
