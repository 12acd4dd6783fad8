"""A4: run summaries over a streaming result topic, with keyed state.

State per topic partition is the open segment alone: for every source the
number of results, the last arrival and the summed processing time since the
last marker.  A marker emits the active sources and resets the state.

Rows reach the state reduced: inside a task, results with consecutive offsets
are merged per source.  No marker of another task can lie between consecutive
offsets, so the merged row takes its place by its first offset.  For the same
reason a segment is whole once consecutive offsets lead from one marker to the
next: the task sums it up, and its rows pass the operator in lanes of their
own, beside the partition's state.  The state gets what lies before the first
and after the last marker of such a stretch, so its rows grow with the tasks
and with the gaps in the offsets, not with the markers.  The state operator
puts the rows of a micro-batch in offset order; a topic delivers offsets in
order from one micro-batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import MARKER_FIELDS, all_sources, classify, summary_rows, weighted_rows
from ..session import scratch_path
from .state import as_text, from_text, merged, start_stateful

_MARKER = MARKER_FIELDS.fieldNames()
# names without a leading underscore: the state operator renames the others
_MERGES = {"offset": "min", "weight": "sum", "arrival": "max", "proc": "sum", **{n: "max" for n in _MARKER}}


#: Lanes of whole segments; lane 0 is the partition's state.
LANES = 16


def _runs(parts: list[str]):
    """Task body: whole segments as rows of their marker and source in a lane above 0; around them, in lane 0,
    results with consecutive offsets of one partition merged per source, and markers as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t.sort_by([(c, "ascending") for c in [*parts, "offset"]])
            at = np.asarray(pc.fill_null(t["offset"], np.iinfo(np.int64).min))
            marker = np.asarray(t["is_marker"])
            gap = np.ones(len(t), bool)
            gap[1:] = np.diff(at) != 1
            for c in parts:
                code = np.asarray(pc.fill_null(t[c].combine_chunks().dictionary_encode().indices, -1))
                gap[1:] |= code[1:] != code[:-1]
            new = gap | marker
            new[1:] |= marker[:-1]
            run = np.cumsum(new)
            # the markers around a row: whole segments have both in their stretch of consecutive offsets
            marks, stretch = np.append(np.flatnonzero(marker), len(t)), np.cumsum(gap)
            closing = np.searchsorted(marks[:-1], np.arange(len(t)))
            close, before = marks[closing], np.append(-1, marks)[closing]
            of = np.append(stretch, 0)  # places -1 and len(t): none
            whole = (of[close] == stretch) & (of[before] == stretch)
            end = np.where(whole, close, np.arange(len(t)))
            for c in ("offset", *_MARKER):  # a row of a whole segment takes its marker's fields
                t = t.set_column(t.schema.get_field_index(c), t.schema.field(c), t[c].take(pa.array(end)))
            t = t.set_column(t.schema.get_field_index("lane"), t.schema.field("lane"),
                             pa.array(np.where(whole, 1 + end % LANES, 0), pa.int32()))
            t = t.append_column("run", pa.array(np.where(whole, -1 - end, run))).filter(pa.array(~(whole & marker)))
            keys = [*parts, "lane", "is_marker", "source"]
            yield from merged(t, [*keys, "run"], _MERGES).select([*keys, *_MERGES]).to_batches()

    return run


class _Segments(StatefulProcessor):
    """Folds results into the open segment of a partition; a marker emits and resets it.  Whole segments pass."""

    def __init__(self, parts: list[str], names: list[str]):
        self.parts, self.names = parts, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "n array<bigint>, latest array<bigint>, spent array<bigint>, spent_n array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *key, lane = key
        if lane:
            for d in rows:
                d = d[d["arrival"].fillna(-1) > 0]
                if len(d):
                    yield self._out(key, d["offset"], d["source"], d, d["weight"], d["arrival"], d["proc"])
            return
        d = pd.concat(list(rows)).sort_values("offset", na_position="first", kind="stable")
        marker = d["is_marker"].to_numpy(bool)
        segment = np.cumsum(marker) - marker  # markers before the row
        k, last = len(self.names), int(marker.sum())
        source = d["source"].map({n: i for i, n in enumerate(self.names)}).to_numpy(np.int64)
        n, spent, spent_n = (np.zeros((last + 1, k), np.int64) for _ in range(3))
        latest = np.full((last + 1, k), -1, np.int64)
        if self.open.exists():
            n[0], latest[0], spent[0], spent_n[0] = (np.array(x, np.int64) for x in self.open.get())
        at = segment[~marker], source[~marker]
        has = d.loc[~marker, "proc"].notna().to_numpy()
        proc = d.loc[~marker, "proc"].fillna(0).to_numpy(np.int64)
        np.add.at(n, at, d.loc[~marker, "weight"].to_numpy(np.int64))
        np.maximum.at(latest, at, d.loc[~marker, "arrival"].fillna(-1).to_numpy(np.int64))
        np.add.at(spent, at, proc)
        np.add.at(spent_n, at, has.astype(np.int64))
        self.open.update(tuple(x[last].tolist() for x in (n, latest, spent, spent_n)))
        if last:
            seg, src = np.nonzero(latest[:last] > 0)
            if len(seg):
                marks = d[marker].iloc[seg]
                yield self._out(key, marks["offset"], [self.names[i] for i in src], marks, n[seg, src], latest[seg, src],
                                np.where(spent_n[seg, src] > 0, spent[seg, src].astype(object), None))

    def _out(self, key, offset, tool, marks: pd.DataFrame, n, latest, spent) -> pd.DataFrame:
        text = lambda xs: pd.Series(list(xs), dtype=object)  # noqa: E731  Arrow-backed text is not taken
        long = lambda xs: pd.array(xs.to_numpy() if isinstance(xs, pd.Series) else xs, dtype="Int64")
        out = {p: text([v] * len(marks)) for p, v in zip(self.parts, key)}
        out |= {"offset": long(offset), "tool": text(tool)} | {c: long(marks[c]) for c in _MARKER}
        return pd.DataFrame(out | {"number_of_windows": long(n), "max_timestamp": long(latest), "processing_time": long(spent)})


def stream_summaries(messages: DataFrame, marker_key: str, sources, default: str, constants: dict | None = None,
                     partition_cols=("partition",)) -> DataFrame:
    """A4 as a streaming DataFrame: the rows of ``run_summary`` (and the marker's ``offset``) as markers arrive.

    Results after a partition's last marker stay open and are not reported.
    """
    parts, names = list(partition_cols), all_sources(sources, default)
    rows = weighted_rows(classify(messages, marker_key, sources, default), parts)
    keys, kinds = [f"part{i}" for i in range(len(parts))], {p: rows.schema[p].dataType for p in parts}
    rows = rows.select(*[as_text(F.col(p), kinds[p]).alias(k) for p, k in zip(parts, keys)], F.lit(0).alias("lane"), "is_marker", "source", "offset", F.col("_w").alias("weight"),
                       F.col("_arr").alias("arrival"), F.col("_proc").alias("proc"), *_MARKER)
    of_parts = rows.schema.fields[:len(keys)]
    rows = rows.mapInArrow(_runs(keys), rows.schema)
    out = T.StructType(of_parts + [T.StructField("offset", T.LongType()), T.StructField("tool", T.StringType())]
                       + [T.StructField(c, T.LongType()) for c in [*_MARKER, "number_of_windows", "max_timestamp", "processing_time"]])
    got = rows.groupBy(*keys, "lane").transformWithStateInPandas(_Segments(keys, names), out, "Append", "None")
    got = got.select(*[from_text(F.col(k), kinds[p]).alias(p) for p, k in zip(parts, keys)], *got.columns[len(keys):])
    # closed segments and active sources only: what summary_rows asks for holds for every row
    return summary_rows(got.withColumns({"_closed": F.lit(1), "segment": F.lit(0)}), constants, parts, keep=["offset"]).drop("segment")


#: Parts of the state: it has a row per topic partition, and few rows reach it.
STATE_PARTITIONS = 4


class SummaryStream:
    """A4 into files under ``base``: the summaries and the query's checkpoint."""

    def __init__(self, spark: SparkSession, marker_key: str, sources, default: str, constants: dict | None = None,
                 base: str | None = None, partition_cols=("partition",)):
        self.spark = spark
        self.settings = marker_key, list(sources), default, dict(constants or {}), list(partition_cols)
        self.base = base or scratch_path(spark, "summary", keep=True)
        self.out_dir, self.checkpoint = f"{self.base}/summary", f"{self.base}/checkpoint"

    def start(self, messages: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return start_stateful(stream_summaries(messages, *self.settings), self.out_dir, self.checkpoint, trigger, STATE_PARTITIONS)

    def result(self) -> DataFrame:
        """Every summary row written so far."""
        return self.spark.read.parquet(self.out_dir)
