"""Extension: metrics of a stream of evaluations, a row for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftpool.functions.metrics import Tracker


def track_stream(evaluations: DataFrame, tracker: Tracker, archive_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the archive and logs the metrics of all of it.

    Mergeable metrics follow from the batch and the tracker's state: the archive
    is read by a tracker's first batch, and by other metrics. A batch that is
    delivered again replaces its own files; one that the tracker has is not
    logged again.
    """

    def each(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{archive_path}/batch_nr={number}")
        archive = rows.sparkSession.read.parquet(archive_path)
        if tracker.get_batch(number) is None:
            tracker.log_batch(number, archive, batch=rows)

    return evaluations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
