"""Batch tagging of a stream (B1, B2).

The place of a row in its partition's sequence is the number of rows in
earlier micro-batches, which is carried as one count per partition, plus its
place within the micro-batch, which comes from distributed prefix sums
(``plans.prefix``).  A batch is full when the count passes its end, so markers
follow from the counts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.batches import batch_of
from ..plans.aggregate import null_safe_join
from ..plans.prefix import ordinal
from ..session import remove_path, scratch_path
from ..sources.sinks import each_batch, write_results
from .state import combined

CARRIED = "_carried"


class BatchTags:
    """B1 on a stream: ``batch_id`` and ``batch_size`` for every row, written per micro-batch.

    Each micro-batch continues the sequence of its partitions in ``order_col``
    order; rows of a later micro-batch come after those of an earlier one, as
    a topic delivers them.  The counts are kept by micro-batch id next to the
    checkpoint, so a micro-batch that is run again starts from the same counts
    and overwrites its own output.
    """

    def __init__(self, spark: SparkSession, order_col: str, sizes, partition_cols=(), *, tie_cols=(), base: str | None = None,
                 sink: Callable[[DataFrame, int], None] | None = None):
        """``sink``: called with the tagged rows and the micro-batch id instead of writing them under ``base/out``."""
        self.spark, self.order_col, self.sizes = spark, order_col, list(sizes)
        self.parts, self.ties = list(partition_cols), list(tie_cols)
        self.base = base or scratch_path(spark, "batches", keep=True)
        self.out_dir, self.count_dir, self.checkpoint = (f"{self.base}/{n}" for n in ("out", "counts", "checkpoint"))
        self.sink = sink or self._write

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        write_results(rows, f"{self.out_dir}/micro_batch={batch_id}", "parquet", mode="overwrite")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        schema = T.StructType([*[batch.schema[p] for p in self.parts], T.StructField(CARRIED, T.LongType())])
        before = (self.spark.createDataFrame([], schema) if batch_id == 0
                  else self.spark.read.schema(schema).parquet(f"{self.count_dir}/batch_id={batch_id - 1}"))
        # a micro-batch may come in one file, that is one task: its rows are placed by as many as there are cores
        batch = batch.repartition(self.spark.sparkContext.defaultParallelism).persist()
        try:
            here = batch.groupBy(*self.parts).agg(F.count(F.lit(1)).alias(CARRIED))
            after = before.unionByName(here).groupBy(*self.parts).agg(F.sum(CARRIED).alias(CARRIED))
            rows = ordinal(batch, self.order_col, self.parts, out="_rn", tie_cols=self.ties)
            if self.parts:
                start = here.select(*self.parts, F.lit(0).cast("long").alias(CARRIED)).unionByName(before)
                start = start.groupBy(*self.parts).agg(F.sum(CARRIED).alias(CARRIED))  # every partition of the rows, once
                rows = null_safe_join(rows, start, self.parts)
            else:
                rows = rows.withColumn(CARRIED, F.coalesce(before.agg(F.sum(CARRIED)).scalar(), F.lit(0)))
            number, size = batch_of(F.col("_rn") + F.col(CARRIED), self.sizes)
            self.sink(rows.withColumns({"batch_id": number, "batch_size": size}).drop("_rn", CARRIED), batch_id)
            after.write.mode("overwrite").parquet(f"{self.count_dir}/batch_id={batch_id}")
            if batch_id >= 2:  # a retried micro-batch reads the counts of the one before
                remove_path(self.spark, f"{self.count_dir}/batch_id={batch_id - 2}")
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return each_batch(stream, self.process, self.checkpoint, trigger=trigger)

    def result(self) -> DataFrame:
        """Every tagged row written so far."""
        return self.spark.read.parquet(self.out_dir).drop("micro_batch")


class _Markers(StatefulProcessor):
    """Rows seen so far in a partition; a marker for every batch whose end the count reaches."""

    def __init__(self, sizes: list[int], out: list[str]):
        self.sizes, self.out = sizes, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "rows bigint, batch bigint, ends bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows so far, the open batch (from 0), and where it ends
        seen, batch, end = self.seen.get() if self.seen.exists() else (0, 0, self.sizes[0])
        seen += sum(r["rows"] for r in rows)
        while end <= seen:
            yield Row(**dict(zip(self.out, (*key, batch + 1, self.sizes[batch % len(self.sizes)]))))
            batch += 1
            end += self.sizes[batch % len(self.sizes)]
        self.seen.update((seen, batch, end))


def stream_batch_markers(df: DataFrame, sizes, partition_cols=()) -> DataFrame:
    """B2 on a stream: ``partition_cols, batch_id, batch_size`` once for every batch, as it fills.

    The open batch has none.  What reaches the state is a count per task.
    """
    parts, sizes = list(partition_cols), list(sizes)
    keys = [f"part{i}" for i in range(max(1, len(parts)))]
    rows = df.select(*[F.col(p).alias(k) for p, k in zip(parts, keys)], *([] if parts else [F.lit(0).alias(keys[0])]),
                     F.lit(1).cast("long").alias("rows"))
    rows = combined(rows, keys, {"rows": "sum"})
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("batch_id", T.LongType()), T.StructField("batch_size", T.LongType())])
    got = rows.groupBy(*keys).transformWithState(_Markers(sizes, out.names), out, "Append", "None")
    return got.select(*[F.col(k).alias(p) for p, k in zip(parts, keys)], "batch_id", "batch_size")
