"""Plan compiler: measures x window spec -> one grouped aggregation.

Shapes (chosen from the window kind and whether a uniqueness measure is
present; every level below the first works on partials, never on rows):

* tumbling            ``groupBy(tags, window(ts, d))``                      1 level
* sliding, batch      rows -> panes of gcd(d, s) -> windows                 2 levels
* sliding, stream     ``groupBy(tags, window(ts, d, s))``                  1 level
* sliding, batch, with uniqueness: the pane plan for everything else, plus
  (value, pane) counts turned into ranges of windows (see ``sliding``)
* session, batch      rows -> gap-sized buckets -> sessions (see sessions)  2 levels
* session, stream     ``groupBy(tags, session_window(ts, gap))``            1 level
* + uniqueness        one more level keyed by the value; the value level is
                      merged into windows before the window level.
* + several uniqueness columns on a stream: the value level is keyed by the
                      number of the column and its value

Skew: every level is a plain ``groupBy`` of mergeable aggregates, so Spark
combines map-side before the shuffle and a hot key (a third of all rows in
one tag, window or value) costs one partial row per task, not one task.
"""

from __future__ import annotations

import re
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import WindowSpec, spark_interval
from ..functions.time import event_time, floor_div, from_micros, to_micros
from ..operators.measures import N, Measure, Partial
from .sessions import session_ids, session_totals

WS, WE = "window_start", "window_end"
ALL_KEY = "_all"  # constant *column* used when a streaming session has no tag


def check_columns(df: DataFrame, names) -> None:
    missing = [c for c in names if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; have {df.columns}")


def whole_columns(df: DataFrame) -> frozenset:
    """Columns of whole numbers, whose sums could overflow their own type."""
    return frozenset(f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))


def collect_partials(measures, whole=frozenset()) -> list[Partial]:
    seen: dict[str, Partial] = {N: Partial(N, F.count(F.lit(1)), "sum", F.lit(1).cast("long"))}
    for m in measures:
        for p in m.partials(whole):
            seen.setdefault(p.name, p)
    return list(seen.values())


#: Column names the plans use themselves.
RESERVED = re.compile(r"_(n|w|p|k|ws|b|sid|us|d|blk|v|seed|all|chunk|tmin|tmax|closed|start|c|u[0-9]+)$|_(nn|max|min|sum|in|out|neg|uq1|uqn)__")


def check_names(names, tags) -> None:
    """Output names must differ from each other, from tags and bounds, and from the plans' own columns."""
    taken = {*tags, WS, WE}
    for n in names:
        if n in taken or RESERVED.match(n):
            raise ValueError(f"output name {n!r} is taken; choose another (tags {list(tags)}, bounds and inner names are reserved)")
        taken.add(n)


def _extra(tags, u) -> list[str]:
    """Grouping column for the value level (none when the value is a tag)."""
    return [u] if u and u not in tags else []


def _merge(partials, extra=()) -> list[Column]:
    return [p.merged() for p in partials] + list(extra)


def _unique_parts(u: str) -> list[Column]:
    """Merge a (window, value)-level table into the window level."""
    c = F.col(u)
    return [F.sum(F.when(c.isNotNull() & (F.col(N) == 1), 1).otherwise(0)).cast("long").alias(f"_uq1__{u}"),
            F.sum(F.when(c.isNotNull(), F.col(N)).otherwise(0)).cast("long").alias(f"_uqn__{u}")]


def null_safe_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on ``keys`` where null tags match each other."""
    r = right.select([F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


# --------------------------------------------------------------------------
def _plan_time_window(df, spec: WindowSpec, ts, tags, partials, u):
    """Tumbling, and sliding when streaming: Spark's window()."""
    if spec.kind == "tumbling":
        w = F.window(ts, spark_interval(spec.duration_ms))
    else:
        w = F.window(ts, spark_interval(spec.duration_ms), spark_interval(spec.slide_ms))
    keys = list(tags) + ["_w"]
    level = df.groupBy(*tags, w.alias("_w"), *_extra(tags, u)).agg(*[p.expr.alias(p.name) for p in partials])
    if u:
        level = level.groupBy(*keys).agg(*_merge(partials, _unique_parts(u)))
    return level.select(*tags, F.col("_w.start").alias(WS), F.col("_w.end").alias(WE),
                        *[c for c in level.columns if c not in keys])


def _plan_stacked(df, spec: WindowSpec, ts, tags, partials, uniq):
    """Several uniqueness columns of a stream in one pair of stateful aggregates: a row enters the value level
    once per column, marked with the column's number; the other partials are taken from the first."""
    step = [spark_interval(spec.slide_ms)] if spec.kind == "sliding" else []
    rows = df.withColumn("_c", F.explode(F.array(*[F.lit(i) for i in range(len(uniq))])))
    rows = rows.withColumns({f"_u{i}": F.when(F.col("_c") == i, F.col(u)) for i, u in enumerate(uniq)})
    values = [f"_u{i}" for i in range(len(uniq))]
    level = rows.groupBy(*tags, F.window(ts, spark_interval(spec.duration_ms), *step).alias("_w"), "_c", *values).agg(
        *[p.expr.alias(p.name) for p in partials])
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = [merge[p.merge](F.when(F.col("_c") == 0, F.col(p.name))).alias(p.name) for p in partials]
    for i, u in enumerate(uniq):
        there = F.col(f"_u{i}").isNotNull()
        parts += [F.sum(F.when(there & (F.col(N) == 1), 1).otherwise(0)).cast("long").alias(f"_uq1__{u}"),
                  F.sum(F.when(there, F.col(N)).otherwise(0)).cast("long").alias(f"_uqn__{u}")]
    level = level.groupBy(*tags, "_w").agg(*parts)
    return level.select(*tags, F.col("_w.start").alias(WS), F.col("_w.end").alias(WE), *level.columns[len(tags) + 1:])


def _plan_panes(df, spec: WindowSpec, ts, tags, partials, uniq, dtype):
    """Sliding batch: aggregate panes of gcd(d, s) once, then fan panes out.

    Each row is aggregated once; only pane partials are replicated to the
    d/s windows that cover them (window() would replicate every row).
    Uniqueness adds its own counts per window (``sliding.unique_events``).
    """
    d, s = spec.duration_ms * 1000, spec.slide_ms * 1000
    g = gcd(d, s)
    pane = floor_div(to_micros(ts, dtype), g).alias("_p")
    lvl = df.groupBy(*tags, pane).agg(*[p.expr.alias(p.name) for p in partials])
    p = F.col("_p")
    k_hi = floor_div(p * g, s)
    k_lo = -floor_div(-((p + 1) * g - d), s)
    lvl = lvl.where(k_lo <= k_hi).withColumn("_k", F.explode(F.sequence(k_lo, k_hi))).drop("_p")
    keys = list(tags) + ["_k"]
    if uniq:
        from .sliding import unique_counts
        lvl = unique_counts(lvl, df.select("*", pane), tags, uniq, partials, d // g, s // g)
    else:
        lvl = lvl.groupBy(*keys).agg(*_merge(partials))
    start = F.col("_k") * s
    return lvl.select(*tags, from_micros(start, dtype).alias(WS), from_micros(start + d, dtype).alias(WE),
                      *[c for c in lvl.columns if c not in keys])


def _plan_session_batch(df, spec: WindowSpec, ts, tags, partials, u, dtype):
    g = spec.gap_ms * 1000
    us = to_micros(ts, dtype)
    b = floor_div(us, g).alias("_b")
    bounds = [Partial("_tmin", F.min(us), "min"), Partial("_tmax", F.max(us), "max")]
    parts = list(partials) + bounds
    lvl = df.groupBy(*tags, b, *_extra(tags, u)).agg(*[p.expr.alias(p.name) for p in parts])
    keys = list(tags) + ["_sid"]
    if u:
        # bucket bounds straight from the scan: two columns, combined map-side to
        # one row per (tag, bucket) -- cheaper than re-grouping the value level
        buckets = df.groupBy(*tags, b).agg(F.min(us).alias("_tmin"), F.max(us).alias("_tmax"))
        sess = session_ids(buckets, tags, g).select(*tags, "_b", "_sid")
        lvl = null_safe_join(lvl, sess, list(tags) + ["_b"]).drop("_b")
        lvl = lvl.groupBy(*keys, *_extra(tags, u)).agg(*_merge(parts))
        lvl = lvl.groupBy(*keys).agg(*_merge(parts, _unique_parts(u)))
    else:
        lvl = session_totals(lvl, tags, g, parts)
    return lvl.select(*tags, from_micros(F.col("_sid"), dtype).alias(WS),
                      from_micros(F.col("_tmax") + g, dtype).alias(WE),
                      *[c for c in lvl.columns if c not in keys + ["_tmin", "_tmax"]])


def _plan_session_stream(df, spec: WindowSpec, ts, tags, partials, u):
    if u:
        raise NotImplementedError(
            "uniqueness over streaming session windows: Spark's session operator would hold every value of "
            "an open session in one group; use winsight.streaming.sessions.SessionMeasures "
            "(Suite.stream_sessions / Monitor.start do this for you)")
    keys = list(tags)
    if not keys:  # Spark rejects global session aggregation; a constant column passes
        df = df.withColumn(ALL_KEY, F.coalesce(F.col(ts).isNull(), F.lit(True)).cast("int") * 0)
        keys = [ALL_KEY]
    w = F.session_window(ts, spark_interval(spec.gap_ms)).alias("_w")
    lvl = df.groupBy(*keys, w).agg(*[p.expr.alias(p.name) for p in partials])
    return lvl.select(*tags, F.col("_w.start").alias(WS), F.col("_w.end").alias(WE),
                      *[c for c in lvl.columns if c not in keys + ["_w"]])


# --------------------------------------------------------------------------
def windowed_measures(df: DataFrame, spec: WindowSpec, time_col: str, measures: dict[str, Measure],
                      tags=(), *, watermark: str | None = None) -> DataFrame:
    """One row per (tags, window): ``tags, window_start, window_end, <measure names>``.

    Works on batch and streaming DataFrames; streaming inputs get a watermark
    on ``time_col`` (default delay 0, i.e. ``wait_for_late=0``).
    """
    tags = list(tags)
    check_columns(df, [time_col, *tags, *[m.column for m in measures.values()]])
    streaming = df.isStreaming
    source_type = df.schema[time_col].dataType
    df = event_time(df, time_col)
    dtype = df.schema[time_col].dataType
    used = list(dict.fromkeys([time_col, *tags, *[m.column for m in measures.values() if m.column]]))
    df = df.select(*used)
    if streaming:
        df = df.withWatermark(time_col, watermark or "0 seconds")
    else:
        df = df.where(F.col(time_col).isNotNull())

    check_names(measures, tags)
    uniq = list(dict.fromkeys(m.column for m in measures.values() if m.kind == "unique"))
    partials = collect_partials(measures.values(), whole_columns(df))

    def plan(parts, u):
        if spec.kind == "tumbling" or (spec.kind == "sliding" and streaming):
            return _plan_time_window(df, spec, time_col, tags, parts, u)
        if streaming:
            return _plan_session_stream(df, spec, time_col, tags, parts, u)
        return _plan_session_batch(df, spec, time_col, tags, parts, u, dtype)

    if spec.kind == "sliding" and not streaming:
        out = _plan_panes(df, spec, time_col, tags, partials, uniq, dtype)
        uniq = []
    elif streaming and len(uniq) > 1 and spec.kind != "session":
        out = _plan_stacked(df, spec, time_col, tags, partials, uniq)
        uniq = []
    else:
        out = plan(partials, uniq[0] if uniq else None)
    if len(uniq) > 1:
        for u in uniq[1:]:
            extra = plan([Partial(N, F.count(F.lit(1)), "sum")], u).drop(N)
            out = null_safe_join(out, extra, tags + [WS, WE])
    bounds = [F.col(WS), F.col(WE)]
    if isinstance(source_type, T.TimestampNTZType) and not isinstance(dtype, T.TimestampNTZType):
        # stream ran on session-zone timestamps: hand back the caller's type
        bounds = [from_micros(to_micros(b, dtype), source_type).alias(n) for b, n in zip(bounds, (WS, WE))]
    return out.select(*tags, *bounds, *[m.value().alias(name) for name, m in measures.items()])
