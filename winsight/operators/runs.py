"""Run analytics on result messages and timing files.

A *result message* is a row with ``partition, offset, key, value (JSON),
timestamp``.  Marker messages (key ``marker_key``) close a batch: every
result since the previous marker of the same partition belongs to it, in
offset (arrival) order.  Results after the last marker form an open segment
and are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import arrival_ms, route_by_key
from ..plans.prefix import running_sum

RESULT_FIELDS = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("checkingTimeMs", T.LongType()),
])

MARKER_FIELDS = T.StructType([
    T.StructField("blast_id", T.LongType()),
    T.StructField("blast_size", T.LongType()),
    T.StructField("blast_start_time", T.LongType()),
    T.StructField("blast_end_time", T.LongType()),
])


def classify(messages: DataFrame, marker_key: str, sources, default: str) -> DataFrame:
    """P8 + P9: add ``is_marker``, ``source`` and ``arrival`` (epoch ms)."""
    key = F.col("key").cast("string")
    return (messages.withColumn("is_marker", F.coalesce(key == F.lit(marker_key), F.lit(False)))
                    .withColumn("source", route_by_key("key", sources, default))
                    .withColumn("arrival", arrival_ms("timestamp")))


def segment_by_marker(df: DataFrame, is_marker="is_marker", order_col: str = "offset",
                      partition_cols=("partition",), out: str = "segment") -> DataFrame:
    """A1: segment = number of markers strictly before the row (per partition)."""
    flag = F.col(is_marker) if isinstance(is_marker, str) else is_marker
    return running_sum(df, flag.cast("long"), order_col, partition_cols, inclusive=False, out=out)


def source_totals(segmented: DataFrame, partition_cols=("partition",), segment: str = "segment") -> DataFrame:
    """A2: per segment and source: windows, last arrival (-1 if none) and
    summed processing time (``checkingTimeMs``, else arrival - ``time``), from
    segmented :func:`weighted_rows`."""
    return (segmented.where(~F.col("is_marker"))
            .groupBy(*partition_cols, segment, "source")
            .agg(F.sum("_w").alias("number_of_windows"),
                 F.coalesce(F.max("_arr"), F.lit(-1)).cast("long").alias("max_timestamp"),
                 F.sum("_proc").cast("long").alias("processing_time")))


def weighted_rows(classified: DataFrame, partition_cols=("partition",)) -> DataFrame:
    """Classified messages reduced to numbers: weight 1, arrival, processing
    time (results) or marker fields (markers).  JSON is parsed here, only for
    the rows that need it, and the raw value goes no further: it never rides
    through the segmentation's shuffle."""
    m = F.col("is_marker")
    res = F.from_json(F.col("value").cast("string"), RESULT_FIELDS)
    mk = F.from_json(F.col("value").cast("string"), MARKER_FIELDS)
    return classified.select(
        *partition_cols, "is_marker", "offset", "source", F.lit(1).cast("long").alias("_w"),
        F.col("arrival").cast("long").alias("_arr"),
        F.when(~m, F.coalesce(res["checkingTimeMs"], F.col("arrival") - res["time"])).cast("long").alias("_proc"),
        *[F.when(m, mk[n]).cast("long").alias(n) for n in MARKER_FIELDS.fieldNames()])


def segment_summaries(rows: DataFrame, sources, partition_cols=("partition",), segment: str = "segment") -> DataFrame:
    """One row per (partition, segment): per-source totals as conditional
    aggregates over the fixed source list, and the closing marker's fields.

    A segment holds at most one marker (the one that closes it), so no join
    is needed to put marker and totals side by side.
    """
    aggs = []
    for i, name in enumerate(sources):
        sel = ~F.col("is_marker") & (F.col("source") == F.lit(name))
        aggs += [F.sum(F.when(sel, F.col("_w"))).alias(f"_n{i}"), F.max(F.when(sel, F.col("_arr"))).alias(f"_m{i}"),
                 F.sum(F.when(sel, F.col("_proc"))).alias(f"_p{i}")]
    m = F.col("is_marker")
    aggs += [F.max(m.cast("int")).alias("_closed"), F.max(F.when(m, F.col("offset"))).alias("offset")]
    aggs += [F.max(n).alias(n) for n in MARKER_FIELDS.fieldNames()]
    return rows.groupBy(*partition_cols, segment).agg(*aggs)


def per_source(summaries: DataFrame, sources) -> DataFrame:
    """Unpivot :func:`segment_summaries` to one row per source (all sources)."""
    items = F.array(*[F.struct(F.lit(name).alias("tool"),
                               F.coalesce(F.col(f"_n{i}"), F.lit(0)).cast("long").alias("number_of_windows"),
                               F.coalesce(F.col(f"_m{i}"), F.lit(-1)).cast("long").alias("max_timestamp"),
                               F.col(f"_p{i}").cast("long").alias("processing_time"))
                      for i, name in enumerate(sources)])
    drop = [c for c in summaries.columns if c.startswith(("_n", "_m", "_p")) and c[2:].isdigit()]
    return summaries.select("*", F.inline(items)).drop(*drop)


def summary_rows(per_src: DataFrame, constants: dict | None, partition_cols=("partition",),
                 segment: str = "segment", keep=()) -> DataFrame:
    """Closed segments, active sources (F3), marker fields with -1 for missing, constants."""
    consts = [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    marker = [F.coalesce(F.col(n), F.lit(-1)).cast("long").alias(n) for n in MARKER_FIELDS.fieldNames()]
    return (per_src.where((F.col("_closed") == 1) & (F.col("max_timestamp") > 0))
                   .select(*partition_cols, *keep, segment, "tool", *marker, "number_of_windows", "max_timestamp",
                           "processing_time", *consts))


def all_sources(sources, default: str) -> list[str]:
    return list(dict.fromkeys([*sources, default]))


def run_summary(messages: DataFrame, marker_key: str, sources, default: str, constants: dict | None = None,
                partition_cols=("partition",)) -> DataFrame:
    """A3: one row per (marker, active source): marker fields, totals of the
    segment it closes, run constants.  A source is active when its last
    arrival is > 0 (F3).  One segmentation pass and one grouping; no join."""
    parts = list(partition_cols)
    seg = segment_by_marker(weighted_rows(classify(messages, marker_key, sources, default), parts), partition_cols=parts)
    names = all_sources(sources, default)
    per_src = per_source(segment_summaries(seg, names, parts), names)
    return summary_rows(per_src, constants, parts)


# ---------------------------------------------------------------- timings
def latest_by_run(timings: DataFrame, run_col: str = "run", file_col: str = "file",
                  ts_col: str = "timestamp", max_files: int | None = None) -> DataFrame:
    """A5: greatest timestamp per run over its files, and how many files there are.

    A run folder written by a distributed job has a file per task, so every
    run counts.  ``max_files`` leaves out runs with more files, for folders
    where that marks a broken run; it is off by default.
    """
    latest = timings.groupBy(run_col).agg(F.max(ts_col).cast("long").alias("latest"), F.countDistinct(file_col).alias("n_files"))
    return latest if max_files is None else latest.where(F.col("n_files") <= max_files)


def run_elapsed(latest: DataFrame, start: Column | int, elements: int, sleep: float) -> DataFrame:
    """elapsed = latest - start - elements x sleep."""
    start_c = start if isinstance(start, Column) else F.lit(start)
    return latest.withColumn("elapsed", (F.col("latest") - start_c - F.lit(elements * sleep)).cast("double"))


def run_stats(values: DataFrame, run_col: str = "run", value_col: str = "value") -> DataFrame:
    """Mean and population standard deviation per run."""
    v = F.col(value_col)
    if isinstance(values.schema[value_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = v.cast("decimal(38,0)")  # whole numbers: the sum must not overflow
    # sum / count rather than avg: exact for decimal input, and the same double for any summation order
    return values.groupBy(run_col).agg(
        F.count(v).alias("n"), (F.sum(v).cast("double") / F.nullif(F.count(v), F.lit(0))).alias("mean"),
        F.stddev_pop(v.cast("double")).alias("std"))
