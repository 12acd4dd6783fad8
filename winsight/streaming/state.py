"""What the operators with keyed state share: the state store, and reduction before the shuffle.

A stateful operator works on one key at a time, so a hot key (a tag or a
message partition with a third of all rows) would send all its rows to one
task.  :func:`combined` reduces every task's rows to partial rows first, as
Spark's own aggregates do; what is shuffled and what the operator reads then
grows with the keys of a micro-batch, not with its rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources.sinks import stream_to_files

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PARTITIONS = "spark.sql.shuffle.partitions"
#: A micro-batch read from one file is cut into about as many tasks as there are cores, down to this many bytes.
SPLIT, SPLIT_BYTES = "spark.sql.files.openCostInBytes", 256 << 10
#: Groups a task holds back to merge its batches; beyond them what is merged goes on.
HELD_GROUPS = 100_000


@contextlib.contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep their state in RocksDB, which keyed state needs, in ``partitions`` parts
    (default: the session's); the settings are put back after.  A restart keeps the parts of the first run."""
    wanted = {PROVIDER: ROCKSDB, SPLIT: str(SPLIT_BYTES)} | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_stateful(result: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """A query over keyed state into files: each row once, also after a restart from ``checkpoint``."""
    with keyed_state(result.sparkSession, partitions):
        return stream_to_files(result, path, checkpoint, trigger=trigger)


def run_stateful(result: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Process everything the source holds now and read the result back."""
    spark = result.sparkSession
    base = scratch_path(spark, name)
    q = start_stateful(result, f"{base}/data", f"{base}/checkpoint", {"availableNow": True}, partitions)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(result.schema).parquet(f"{base}/data")


def as_text(column: Column, kind: T.DataType) -> Column:
    """A grouping column that is never null (the pandas side of keyed state takes no null keys): ``=value``, or ``''``."""
    text = F.base64(column) if isinstance(kind, T.BinaryType) else column.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


def from_text(column: Column, kind: T.DataType) -> Column:
    text = F.when(column != "", F.substring(column, 2, 1 << 30))
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def combined(df: DataFrame, keys: list[str], merges: dict[str, str]) -> DataFrame:
    """Rows of equal ``keys`` merged within a task: ``keys`` and the ``merges`` columns.

    ``merges``: column -> ``sum``, ``min`` or ``max``; nulls are skipped.
    A task hands over each key once, unless it has over ``HELD_GROUPS`` of
    them: memory stays at so many groups and a batch.
    """
    schema, most = df.select(*keys, *merges).schema, HELD_GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if len(b):
                here = merged(pa.Table.from_batches([b]), keys, merges)
                held = here if held is None else merged(pa.concat_tables([held, here]), keys, merges)
                if len(held) > most:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from held.to_batches()

    return df.select(*keys, *merges).mapInArrow(run, schema)


def merged(table: pa.Table, keys: list[str], merges: dict[str, str]) -> pa.Table:
    """One row per ``keys``, in the types of ``table``."""
    got = table.group_by(keys, use_threads=False).aggregate([(c, how) for c, how in merges.items()])
    return pa.table([pc.cast(got[name], table.schema.field(c).type)
                     for c, name in [*((k, k) for k in keys), *((c, f"{c}_{how}") for c, how in merges.items())]],
                    names=[*keys, *merges])
