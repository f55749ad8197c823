"""Merged metric states against metrics of the whole archive."""

import warnings

import numpy as np
import pytest

from siftpool.functions import metrics as M
from siftpool.functions.metrics import Tracker

METRICS = {"best": M.best_y, "worst": M.worst_y, "regret": M.make_metric(M.regret, optimum=-2.0), "rmse": M.archive_rmse, "mae": M.archive_mae, "r2": M.archive_r2}


def batches(spark):
    rng = np.random.default_rng(1)
    rows = [(float(y), float(y + e)) for y, e in zip(rng.normal(5, 3, 60), rng.normal(0, 1, 60))] + [(None, 1.0), (2.0, None)]
    cuts = [0, 1, 20, 20, 45, 62]  # one of a single row, one empty
    return [spark.createDataFrame(rows[a:b], "y double, mean double") for a, b in zip(cuts, cuts[1:])]


def test_history_is_that_of_the_whole_archive(spark):
    merged, whole, archive = Tracker(METRICS), Tracker(METRICS), None
    for k, b in enumerate(batches(spark), 1):
        archive = b if archive is None else archive.unionByName(b)
        merged.log_batch(k, archive if k == 1 else None, batch=b)  # the archive is not there to be read
        whole.log_batch(k, archive)
    assert merged.history("r2")[0] == whole.history("r2")[0]
    for k in range(1, 6):
        a, b = merged.get_batch(k), whole.get_batch(k)
        assert a["n_evals"] == b["n_evals"]
        for n in METRICS:
            assert a[n] == pytest.approx(b[n], rel=1e-9), (k, n)


def test_metrics_added_late_and_metrics_that_fail(spark):
    parts = batches(spark)
    first, both = parts[1], parts[1].unionByName(parts[3])
    t = Tracker({"best": M.best_y, "bad": M.make_metric(M.best_y, target="nowhere"), "n": lambda a, s, **_: a.count()})
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        t.log_batch(1, first, batch=first)
        t.add_metric("mae", M.archive_mae)
        row = t.log_batch(2, both, batch=parts[3])
    assert said and row["bad"] is None
    assert row["n_evals"] == row["n"] == both.count() and row["best"] == M.best_y(both) and row["mae"] == pytest.approx(M.archive_mae(both))
    t.clear()
    assert t.log_batch(7, both, batch=parts[3])["n_evals"] == both.count()  # without a state, all of it


def test_stream_reads_batches(spark, tmp_path):
    from siftpool.streaming.history import track_stream

    parts = batches(spark)
    for k, b in enumerate((parts[1], parts[3], parts[4])):
        b.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    t = Tracker({"best": M.best_y, "r2": M.archive_r2})
    stream = spark.readStream.schema("y double, mean double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    track_stream(stream, t, str(tmp_path / "archive"), str(tmp_path / "state")).awaitTermination()
    archive = spark.read.parquet(str(tmp_path / "archive"))
    assert t.n_batches == 3 and t.latest["n_evals"] == archive.count()
    assert t.latest["best"] == M.best_y(archive) and t.latest["r2"] == pytest.approx(M.archive_r2(archive))
