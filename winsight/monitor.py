"""Monitor surface (N1-N3): configure once, add named measures, run or start.

::

    mon = (Monitor(WindowSpec.tumbling("1 minutes"), time_column="created_utc", time_unit="s",
                   source=records)
           .add(measures.count("id_"), "count")
           .add(measures.fraction_of_unique("id_"), "is_id_unique"))
    result = mon.run()            # batch DataFrame, or
    query = mon.start(path=...)   # streaming query, append mode

The measures become one windowed aggregation (see ``plans.aggregate``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .functions.durations import WindowSpec
from .functions.time import epoch_ms, epoch_s, parse_ts
from .operators.measures import Measure
from .plans.aggregate import WE, WS, windowed_measures
from .session import scratch_path
from .sources.sinks import batch_files, each_batch, stream_to_files


@dataclass
class Monitor:
    window: WindowSpec
    time_column: str
    wait_for_late: float = 0
    time_format: str | None = None
    time_unit: str | None = None  # "s" / "ms" for epoch numbers
    show_window_start: bool = True
    show_window_end: bool = True
    tags: tuple = ()
    source: DataFrame | None = None
    sink_operation: Callable[[DataFrame, int], None] | None = None
    sink_path: str | None = None
    measures: dict[str, Measure] = field(default_factory=dict)

    def add(self, measure: Measure, name: str) -> "Monitor":
        """Add a measure under an output column name (chainable)."""
        if name in self.measures or name in (WS, WE, *self.tags):
            raise ValueError(f"duplicate output name {name!r}")
        self.measures[name] = measure
        return self

    def _input(self, df: DataFrame | None) -> DataFrame:
        df = df if df is not None else self.source
        if df is None:
            raise ValueError("no source DataFrame configured")
        tc = self.time_column
        if self.time_unit == "s":
            df = df.withColumn(tc, epoch_s(tc))
        elif self.time_unit == "ms":
            df = df.withColumn(tc, epoch_ms(tc))
        elif self.time_unit is not None:
            raise ValueError(f"time_unit must be 's' or 'ms', got {self.time_unit!r}")
        elif self.time_format is not None and dict(df.dtypes)[tc] == "string":
            df = df.withColumn(tc, parse_ts(tc, self.time_format))
        return df

    def plan(self, df: DataFrame | None = None, *, prepared: bool = False) -> DataFrame:
        """The result DataFrame (batch or streaming, like the source)."""
        if not self.measures:
            raise ValueError("add at least one measure")
        src = df if prepared else self._input(df)
        out = windowed_measures(src, self.window, self.time_column, self.measures, self.tags,
                                watermark=f"{int(self.wait_for_late * 1000)} milliseconds")
        drop = ([WS] if not self.show_window_start else []) + ([WE] if not self.show_window_end else [])
        return out.drop(*drop)

    def run(self, df: DataFrame | None = None) -> DataFrame:
        """N3, batch: the per-window results as a DataFrame."""
        return self.plan(df)

    def start(self, df: DataFrame | None = None, *, path: str | None = None, checkpoint: str | None = None,
              fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
        """N3, streaming: start the query; closed windows are appended to the sink.

        ``sink_operation`` gets every micro-batch's closed windows; otherwise
        they go to ``path`` (or ``sink_path``) as ``fmt``.  A query that has to
        go on after a restart needs a ``checkpoint`` of its own; without one,
        progress is kept in a fresh folder and forgotten.
        """
        src = self._input(df)
        if not src.isStreaming:
            raise ValueError("start() needs a streaming source; use run() for batch")
        spark = src.sparkSession
        base = scratch_path(spark, "monitor", keep=True)
        path = path or self.sink_path or f"{base}/data"
        if self.window.kind == "session" and any(m.kind == "unique" for m in self.measures.values()):
            from .streaming.sessions import SessionMeasures
            drop = ([WS] if not self.show_window_start else []) + ([WE] if not self.show_window_end else [])
            proc = SessionMeasures(spark, self.window, self.time_column, self.measures, self.tags,
                                   delay_ms=int(self.wait_for_late * 1000), base=base, checkpoint=checkpoint,
                                   post=lambda out: out.drop(*drop), sink=self.sink_operation or batch_files(path, fmt))
            return proc.start(src, trigger)
        result = self.plan(src, prepared=True)
        checkpoint = checkpoint or f"{base}/checkpoint"
        if self.sink_operation is not None:
            return each_batch(result, self.sink_operation, checkpoint, trigger=trigger)
        return stream_to_files(result, path, checkpoint, fmt, trigger=trigger)

