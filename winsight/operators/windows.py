"""Row-level window operators: assign (W4, P12), bag of rows (W9), filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import WindowSpec, spark_interval
from ..functions.time import event_time, floor_div, from_micros, to_micros
from ..plans.aggregate import WE, WS, check_columns


def window_column(spec: WindowSpec, time_col: str):
    if spec.kind == "tumbling":
        return F.window(time_col, spark_interval(spec.duration_ms))
    if spec.kind == "sliding":
        return F.window(time_col, spark_interval(spec.duration_ms), spark_interval(spec.slide_ms))
    raise ValueError("session windows are defined by their neighbours; aggregate them with "
                     "windowed_measures / Suite.evaluate instead of assigning per row")


def assign_windows(df: DataFrame, spec: WindowSpec, time_col: str, *, watermark: str | None = None) -> DataFrame:
    """W4 + P12: keep every row, add ``window`` struct and its bounds as columns.

    Sliding windows replicate each row duration/slide times (Spark's Expand).
    Rows without event time belong to no window and are left out.  With
    ``watermark`` (streams only) the windows can be grouped and closed.
    """
    check_columns(df, [time_col])
    df = event_time(df, time_col)
    if watermark is not None:
        df = df.withWatermark(time_col, watermark)
    return (df.where(F.col(time_col).isNotNull())
              .withColumn("window", window_column(spec, time_col))
              .withColumn(WS, F.col("window.start"))
              .withColumn(WE, F.col("window.end")))


def _bounds(df: DataFrame, source_type) -> list:
    """Bounds of ``window`` in the type of the event time as it came in."""
    kind = df.schema["window"].dataType["start"].dataType
    return [(F.col(f"window.{f}") if kind == source_type else from_micros(to_micros(F.col(f"window.{f}"), kind), source_type)).alias(n)
            for f, n in (("start", WS), ("end", WE))]


def collect_rows(df: DataFrame, spec: WindowSpec, time_col: str, tags=(), chunk_rows: int = 10_000, *,
                 chunk_by: str | None = None, watermark: str | None = None) -> DataFrame:
    """The rows of each (tags, window) as arrays of ``struct(*)``.

    A window's bag is split into chunks of at most ``chunk_rows`` input rows,
    so no array grows with the window: a window holding a third of the data is
    many bounded rows.  Output: tags, window_start, window_end, chunk, rows.

    A chunk is ``chunk_rows`` consecutive values of the whole-number column
    ``chunk_by`` (unique per row, such as a message offset within one
    partition named in ``tags``); a row without it goes to a chunk by its
    hash.  Without ``chunk_by`` a batch counts consecutive rows of an input
    partition.  A stream needs it, because a micro-batch that is run again
    has to give a row the same number; it emits a window's chunks once, when
    the watermark (default delay 0) has passed its end.
    """
    check_columns(df, [time_col, chunk_by, *tags])
    streaming = df.isStreaming
    if streaming and chunk_by is None:
        raise ValueError("collect_rows on a stream needs chunk_by, a whole-number column that is unique per row")
    payload, source_type = df.columns, df.schema[time_col].dataType
    place = F.monotonically_increasing_id() if chunk_by is None else F.coalesce(F.col(chunk_by), F.xxhash64(*payload))
    chunk = floor_div(place, chunk_rows)
    win = assign_windows(df.withColumn("_chunk", chunk), spec, time_col, watermark=(watermark or "0 seconds") if streaming else None)
    bags = (win.groupBy(*tags, "window", F.col("_chunk").alias("chunk"))
               .agg(F.collect_list(F.struct(*[F.col(c) for c in payload])).alias("rows")))
    return bags.select(*tags, *_bounds(bags, source_type), "chunk", "rows")


def distinct_windows(windowed: DataFrame, tags=()) -> DataFrame:
    """distinct (tags, window_start, window_end) of :func:`assign_windows`.

    On a stream (assigned with ``watermark``) a window is emitted once, when
    it closes, and its state is dropped with it: grouping by the window
    itself, not by its bare bounds, keeps the watermark.
    """
    if not windowed.isStreaming:
        return windowed.select(*tags, WS, WE).distinct()
    seen = windowed.groupBy(*tags, "window").agg(F.count(F.lit(1)).alias("_n"))
    return seen.select(*tags, F.col("window.start").alias(WS), F.col("window.end").alias(WE))


def rows_of_window(windowed: DataFrame, start, end, tag_values: dict | None = None,
                   time_col: str | None = None) -> DataFrame:
    """rows of one window; tag equality is null-safe (a null tag is a group).

    With ``time_col`` the bounds are also stated on the event time itself, so
    that they reach the scan and files outside the window are not read.
    """
    cond = F.col(WS).eqNullSafe(F.lit(start)) & F.col(WE).eqNullSafe(F.lit(end))
    if time_col is not None:
        cond = cond & (F.col(time_col) >= F.lit(start)) & (F.col(time_col) < F.lit(end))
    for k, v in (tag_values or {}).items():
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    return windowed.where(cond).drop("window", WS, WE)

