"""Structured Streaming runs of suites and measures.

The same plan as batch (``windowed_measures`` / ``Suite.evaluate``) on a
streaming DataFrame: a watermark on the event time (delay 0 by default),
append mode, so each window is emitted once, when the watermark passes its
end.  A row is late -- and dropped -- when its window already closed under
the previous micro-batch's watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources.sinks import batch_files, each_batch, stream_to_files


def start(result: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", *,
          trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start an append-mode file sink for a streaming result."""
    if not result.isStreaming:
        raise ValueError("start() needs a streaming DataFrame; batch results are plain DataFrames")
    return stream_to_files(result, path, checkpoint, fmt, trigger=trigger, query_name=query_name)


def start_with_batch_ids(result: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", *,
                         trigger: dict | None = None) -> StreamingQuery:
    """R1 with ``batch_id``: each micro-batch's closed windows go to
    ``path/batch_id=<id>`` (overwrite, so a retried batch is idempotent);
    reading ``path`` back yields the ``batch_id`` column."""
    return each_batch(result, batch_files(path, fmt), checkpoint, trigger=trigger)


def run_available(spark: SparkSession, result: DataFrame, name: str, fmt: str = "parquet",
                  timeout_s: float | None = None) -> DataFrame:
    """Process everything the source holds now, then read the closed windows back.

    Output and checkpoint go to a fresh folder under ``spark.checkpoint.dir``.
    """
    base = scratch_path(spark, name)
    q = start(result, f"{base}/data", f"{base}/checkpoint", fmt, trigger={"availableNow": True})
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(result.schema).format(fmt).load(f"{base}/data")
