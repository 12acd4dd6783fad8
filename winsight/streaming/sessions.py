"""Session windows over a stream with any measures, uniqueness included.

Spark's streaming session operator keeps one aggregation buffer per session,
so exact uniqueness would need every value of an open session in one group.
Here each micro-batch runs the batch bucket plan (see ``plans.sessions``)
on its new rows *plus* the carried partials of sessions still open:

* carried state = (tags, bucket[, value]) partial rows of open sessions and
  the largest event time seen, written under the checkpoint folder per batch
  id (a retried batch reads the same state and overwrites the same output);
* a session is emitted when the watermark (largest event time - delay) has
  reached its end, the rule of Spark's own session operator;
* rows whose own session ``[ts, ts + gap)`` ends at or before the previous
  batch's watermark are late and dropped.

State is partial rows of open sessions only, spread over (tag, bucket, value)
keys; nothing is collected per session.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.durations import WindowSpec
from ..functions.time import floor_div, from_micros, to_micros
from ..operators.measures import Measure, Partial
from ..plans.aggregate import WE, WS, _extra, _merge, _unique_parts, check_columns, collect_partials, null_safe_join, whole_columns
from ..plans.sessions import session_ids
from ..session import remove_path, scratch_path


def retire(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Delete the state that a finished batch left behind."""
    if batch_id >= 0:
        remove_path(spark, f"{folder}/batch_id={batch_id}")


class SessionMeasures:
    def __init__(self, spark: SparkSession, spec: WindowSpec, time_col: str, measures: dict[str, Measure],
                 tags=(), *, delay_ms: int = 0, post: Callable[[DataFrame], DataFrame] | None = None,
                 base: str | None = None, sink: Callable[[DataFrame, int], None] | None = None,
                 checkpoint: str | None = None):
        """``base``: folder of output, state and checkpoint; ``sink``: called with each
        batch's closed sessions instead of writing them under ``base/out``;
        ``checkpoint``: where the query's progress and the carried state are kept."""
        if spec.kind != "session":
            raise ValueError("SessionMeasures is for session windows; other kinds stream natively")
        uniq = list(dict.fromkeys(m.column for m in measures.values() if m.kind == "unique"))
        if len(uniq) > 1:
            raise NotImplementedError("one uniqueness column per streaming session query")
        self.spark, self.spec, self.ts = spark, spec, time_col
        self.measures, self.tags, self.u = dict(measures), list(tags), (uniq[0] if uniq else None)
        self.gap = spec.gap_ms * 1000
        self.delay = int(delay_ms) * 1000
        self.post = post
        #: Micro-batch id -> rows that came too late for any open session.
        self.late: dict[int, int] = {}
        self.base = base or scratch_path(spark, "sessions", keep=True)
        self.sink = sink
        kept = checkpoint or self.base
        self.out_dir, self.carry_dir, self.state_dir = f"{self.base}/out", f"{kept}/carry", f"{kept}/state"
        self.level_dir, self.checkpoint = f"{kept}/level", f"{kept}/checkpoint"

    # ------------------------------------------------------------- state
    def _keys(self) -> list[str]:
        return self.tags + ["_b"] + _extra(self.tags, self.u)

    def _read(self, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{folder}/batch_id={batch_id - 1}")

    def _kept(self, level: DataFrame, batch_id: int) -> DataFrame:
        """``level`` as files for the micro-batch: few where it is small (a cached one keeps every shuffle partition),
        so what reads it and what it is written into stay as small as it is."""
        path = f"{self.level_dir}/batch_id={batch_id}"
        level.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(level.schema).parquet(path)

    # ------------------------------------------------------------- batch body
    def process(self, batch: DataFrame, batch_id: int) -> None:
        check_columns(batch, [self.ts, *self.tags, *[m.column for m in self.measures.values()]])
        dtype = batch.schema[self.ts].dataType
        self.partials = collect_partials(self.measures.values(), whole_columns(batch)) + [
            Partial("_tmin", F.min("_us"), "min"), Partial("_tmax", F.max("_us"), "max")]
        used = list(dict.fromkeys([self.ts, *self.tags, *[m.column for m in self.measures.values() if m.column]]))
        state = self._read(self.state_dir, batch_id, T.StructType([T.StructField("max_us", T.LongType())]))
        seen_before = state.agg(F.max("max_us")).scalar()
        late = F.coalesce(F.col("_us") + self.gap <= seen_before - self.delay, F.lit(False))
        counted = Observation()
        rows = (batch.select(*used).where(F.col(self.ts).isNotNull()).withColumn("_us", to_micros(self.ts, dtype))
                     .withColumn("_late", late).observe(counted, F.count_if("_late").alias("late")).where(~F.col("_late")).drop("_late"))
        keys = self._keys()
        fresh = rows.groupBy(*self.tags, floor_div(F.col("_us"), self.gap).alias("_b"), *_extra(self.tags, self.u)) \
            .agg(*[p.expr.alias(p.name) for p in self.partials])
        carry = self._read(self.carry_dir, batch_id, fresh.schema)
        level = fresh.unionByName(carry).groupBy(*keys).agg(*_merge(self.partials))
        buckets = level.groupBy(*self.tags, "_b").agg(F.min("_tmin").alias("_tmin"), F.max("_tmax").alias("_tmax"))
        mapping = session_ids(buckets, self.tags, self.gap).select(*self.tags, "_b", "_sid")
        level = self._kept(null_safe_join(level, mapping, self.tags + ["_b"]), batch_id)
        try:
            skeys = self.tags + ["_sid"]
            sess = level.drop("_b").groupBy(*skeys, *_extra(self.tags, self.u)).agg(*_merge(self.partials))
            if self.u:
                sess = sess.groupBy(*skeys).agg(*_merge(self.partials, _unique_parts(self.u)))
            # late rows lie before the previous watermark, so the level (open
            # state + this batch) holds the largest event time seen
            seen_now = F.greatest(seen_before, level.agg(F.max("_tmax")).scalar())
            closed_flag = (F.col("_tmax") + self.gap) <= (seen_now - self.delay)
            closed = F.coalesce(closed_flag, F.lit(False))
            out = sess.where(closed).select(
                *self.tags, from_micros(F.col("_sid"), dtype).alias(WS),
                from_micros(F.col("_tmax") + self.gap, dtype).alias(WE),
                *[m.value().alias(name) for name, m in self.measures.items()])
            if self.post is not None:
                out = self.post(out)
            if self.sink is not None:
                self.sink(out, batch_id)
            else:
                out.write.mode("overwrite").parquet(f"{self.out_dir}/batch_id={batch_id}")
            still_open = level.groupBy(*skeys).agg(F.max("_tmax").alias("_tmax")).where(~closed).select(*skeys)
            # in the types of fresh partials: a merged sum is a wider decimal
            (null_safe_join(level, still_open, skeys).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fresh.schema.fields])
             .write.mode("overwrite").parquet(f"{self.carry_dir}/batch_id={batch_id}"))
            batch.sparkSession.range(1).select(seen_now.cast("long").alias("max_us")) \
                .write.mode("overwrite").parquet(f"{self.state_dir}/batch_id={batch_id}")
            self.late[batch_id] = counted.get["late"]
            # a retried batch reads the state of the batch before it; anything older is of no use
            for folder in (self.carry_dir, self.state_dir):
                retire(self.spark, folder, batch_id - 2)
        finally:
            retire(self.spark, self.level_dir, batch_id)

    def start(self, stream: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", self.checkpoint)
                .trigger(**(trigger or {"processingTime": "1 second"})).start())

    def result(self) -> DataFrame:
        """Every closed session written so far (``batch_id`` from the folder names)."""
        return self.spark.read.parquet(self.out_dir)
