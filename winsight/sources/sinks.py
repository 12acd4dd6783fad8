"""Sinks (K1, K3, K4, K5).  No ``coalesce(1)``: each task writes its own part."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.durations import WindowSpec
from ..session import make_folder, path_exists, remove_path
from .files import NTZ_FORMAT


def results_path(base: str, spec: WindowSpec) -> str:
    """Folder whose name encodes the window settings (one per experiment)."""
    return f"{base.rstrip('/')}/{spec.label().replace(' ', '')}"


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """K1/K4: append result or summary rows (headered CSV by default)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = (w.option("header", True).option("timestampNTZFormat", NTZ_FORMAT)
              .option("quote", '"').option("escape", '"'))
    w.save(path)


append_summary = write_results


def write_values_text(df: DataFrame, path: str, value_col: str, run_col: str, mode: str = "append") -> None:
    """One number per line, one folder per run (A6 output, read back by S5 for A7)."""
    from pyspark.sql import functions as F
    (df.select(F.col(value_col).cast("string").alias("value"), F.col(run_col))
       .write.mode(mode).partitionBy(run_col).text(path))


def stream_to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", *,
                    trigger: dict | None = None, output_mode: str = "append", query_name: str | None = None) -> StreamingQuery:
    """K3: file sink for a streaming result (append; windows arrive once closed)."""
    w = (df.writeStream.format(fmt).outputMode(output_mode).option("path", path)
         .option("checkpointLocation", checkpoint))
    if fmt == "csv":
        w = w.option("header", True)
    if query_name:
        w = w.queryName(query_name)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def batch_files(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A per-micro-batch sink: ``path/batch_id=<id>``, overwritten when a batch is retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_results(batch, f"{path.rstrip('/')}/batch_id={batch_id}", fmt, mode="overwrite")

    return write


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, *,
               trigger: dict | None = None) -> StreamingQuery:
    """K5: per-micro-batch hook, for fan-out to more than one sink."""
    return (df.writeStream.outputMode("append").foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


class FanOut:
    """K5: every micro-batch to several sinks, each of them once.

    ``sinks`` maps a name to a function of the micro-batch and its id.  A
    ledger under ``ledger`` (a shared folder) notes each finished (sink,
    micro-batch id); when a micro-batch is run again after a failure, only the
    sinks that had not finished run.  A sink that fails in the middle has to
    be one that can be repeated (``batch_files`` overwrites); the others see a
    micro-batch once.  The micro-batch is kept for the call, so the sources
    and the state are read once for all sinks.
    """

    def __init__(self, sinks: dict[str, Callable[[DataFrame, int], None]], ledger: str):
        bad = [n for n in sinks if not re.fullmatch(r"[\w-]+", n)]
        if bad or not sinks:
            raise ValueError(f"sink names are letters, digits, '-' and '_': {bad or 'none given'}")
        self.sinks, self.ledger = dict(sinks), ledger.rstrip("/")

    def _entry(self, name: str, batch_id: int) -> str:
        return f"{self.ledger}/sink={name}/batch_id={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        due = {n: fn for n, fn in self.sinks.items() if not path_exists(spark, self._entry(n, batch_id))}
        batch = batch.persist()
        try:
            for name, fn in due.items():
                fn(batch, batch_id)
                make_folder(spark, self._entry(name, batch_id))
        finally:
            batch.unpersist()
        for name in self.sinks:  # every sink has this micro-batch: the one before cannot come again
            if batch_id > 0:
                remove_path(spark, self._entry(name, batch_id - 1))


def late_rows(progress) -> dict[int, int]:
    """Micro-batch id -> what its stateful operators dropped as late, from a query's progress reports.

    Spark counts after rows of one window (and tag, and value) are merged
    within a task, so copies of a late row in one task count once.
    """
    out: dict[int, int] = {}
    for p in progress:
        dropped = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        out[p["batchId"]] = out.get(p["batchId"], 0) + dropped
    return out
