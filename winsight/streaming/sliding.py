"""Sliding windows over a stream, each row aggregated once.

``window(ts, d, s)`` copies a row into each of its ``d / s`` windows before it
is aggregated.  Here a row is merged into its pane, the stretch of
``gcd(d, s)`` that belongs to the same windows, inside its task; the state
holds each pane's partials once per tag, and a window is the merge of its
panes when it closes.

Late rows are told by windows, as with Spark's own windows: a window takes a
row unless the window had closed before the micro-batch.  For that a task
adds, per pane, one row without partials for each window end but the last;
Spark drops the rows whose end lies before the watermark, and what arrives
names the windows that are still open.  A timer per tag stands at its next
open end.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from math import gcd

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.durations import WindowSpec, spark_interval
from ..functions.time import event_time, floor_div, from_micros, to_micros
from ..operators.measures import Measure, Partial
from ..plans.aggregate import WE, WS, check_columns, check_names, collect_partials, whole_columns
from .state import combined

_PICK = {"sum": lambda a, b: a + b, "min": min, "max": max}


def _merge(old, new, how: list[str]) -> list:
    """Partials of two groups as those of their union; a null is no value."""
    return [b if a is None else a if b is None else _PICK[h](a, b) for a, b, h in zip(old, new, how)]


class _Panes(StatefulProcessor):
    """State of a tag: partials per pane, the open window ends, and the end its timer stands at."""

    def __init__(self, out: T.StructType, parts: list[Partial], duration: int, slide: int, pane: int):
        self.out, self.values = out.names, T.StructType(out.fields[-len(parts):])
        self.how = [p.merge for p in parts]
        self.duration, self.slide, self.pane = duration, slide, pane

    def init(self, handle: StatefulProcessorHandle) -> None:
        decimal.getcontext().prec = 76  # sums of wide decimals stay exact
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", self.values)
        self.ends = handle.getMapState("ends", "close bigint", "there boolean")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        panes: dict[int, list] = {}
        ends: set[int] = set()
        for r in rows:
            ends.add(r["close"])
            if r["parts"] is not None:
                values = [r["parts"][n] for n in self.values.names]
                panes[r["pane"]] = _merge(panes[r["pane"]], values, self.how) if r["pane"] in panes else values
        for pane, values in panes.items():
            old = self.panes.getValue((pane,)) if self.panes.containsKey((pane,)) else None
            self.panes.updateValue((pane,), tuple(values if old is None else _merge(old, values, self.how)))
        for end in ends:
            self.ends.updateValue((end,), (True,))
        first = self.timer.get()[0] if self.timer.exists() else None
        if first is None or min(ends) < first:
            self._set_timer(first, min(ends))
        return iter(())

    def _set_timer(self, before: int | None, end: int | None) -> None:
        """A timer fires when the watermark lies beyond it: one millisecond before the end."""
        if before is not None:
            self.handle.deleteTimer(before // 1000 - 1)
        if end is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(end // 1000 - 1)
            self.timer.update((end,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Every window that the watermark has passed; panes of which no window is open go."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        panes = {k[0]: v for k, v in self.panes.iterator()}
        ends = sorted(k[0] for k in self.ends.keys())
        closed = [e for e in ends if e <= now]
        for end in closed:
            values = None
            for pane in range((end - self.duration) // self.pane, end // self.pane):
                if pane in panes:
                    values = panes[pane] if values is None else _merge(values, panes[pane], self.how)
            self.ends.removeKey((end,))
            yield Row(**dict(zip(self.out, (*key, end, *values))))
        for pane in panes:
            if pane * self.pane // self.slide * self.slide + self.duration <= now:
                self.panes.removeKey((pane,))
        self._set_timer(None, ends[len(closed)] if len(closed) < len(ends) else None)


def stream_sliding(df: DataFrame, spec: WindowSpec, time_col: str, measures: dict[str, Measure], tags=(), *,
                   watermark: str | None = None) -> DataFrame:
    """``tags, window_start, window_end`` and the measures, one row per closed window (append).

    For every measure but uniqueness, which needs its values per window and
    stays with ``windowed_measures``.  Same rows as there: late rows count for
    the windows that are still open, the last open windows are not emitted.
    """
    tags = list(tags)
    if spec.kind != "sliding" or not df.isStreaming:
        raise ValueError("stream_sliding is for sliding windows over a stream")
    if any(m.kind == "unique" for m in measures.values()):
        raise ValueError("uniqueness is not mergeable over panes; use windowed_measures")
    check_columns(df, [time_col, *tags, *[m.column for m in measures.values()]])
    check_names(measures, tags)
    source_type = df.schema[time_col].dataType
    df = event_time(df, time_col)
    kind = df.schema[time_col].dataType
    duration, slide = spec.duration_ms * 1000, spec.slide_ms * 1000
    pane = gcd(duration, slide)
    parts = collect_partials(measures.values(), whole_columns(df))
    keys = [f"tag{i}" for i in range(len(tags))]

    # the value of a partial for one row, in the type of the aggregate, merged within the task
    kinds = df.sparkSession.createDataFrame([], df.schema).agg(*[p.expr.alias(p.name) for p in parts]).schema
    names = [f"p{i}" for i in range(len(parts))]
    rows = df.where(F.col(time_col).isNotNull()).select(
        *[F.col(t).alias(k) for t, k in zip(tags, keys)], *([] if tags else [F.lit(0).alias("tag0")]),  # no tag: one group
        floor_div(to_micros(time_col, kind), pane).alias("pane"), F.col(time_col).alias("latest"),
        *[p.of_row().cast(kinds[p.name].dataType).alias(n) for n, p in zip(names, parts)])
    keys = keys or ["tag0"]
    rows = combined(rows, [*keys, "pane"], {"latest": "max", **{n: p.merge for n, p in zip(names, parts)}})

    # the latest row of a pane lies in the pane's windows and moves the watermark as the rows themselves would
    rows = rows.withWatermark("latest", watermark or "0 seconds").select(
        *keys, "pane", F.window("latest", spark_interval(spec.duration_ms), spark_interval(spec.slide_ms)).alias("window"), *names)
    begin, end = (to_micros(F.col(f"window.{n}"), T.TimestampType()) for n in ("start", "end"))
    last = floor_div(F.col("pane") * pane, slide) * slide  # the pane's last window carries its partials
    rows = rows.select(*keys, "pane", "window", end.alias("close"), F.when(begin == last, F.struct(*names)).alias("parts"))
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("close", T.LongType()), *rows.schema["parts"].dataType.fields])
    got = rows.groupBy(*keys).transformWithState(_Panes(out, parts, duration, slide, pane), out, "Append", "EventTime")

    bounds = {WS: F.col("close") - duration, WE: F.col("close")}
    got = got.select(*[F.col(k).alias(t) for k, t in zip(keys, tags)],
                     *[from_micros(c, source_type).alias(n) for n, c in bounds.items()],
                     *[F.col(n).alias(p.name) for n, p in zip(names, parts)])
    return got.select(*tags, WS, WE, *[m.value().alias(name) for name, m in measures.items()])
