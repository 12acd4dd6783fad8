"""Uniqueness over sliding windows without copying rows per window.

Rows are counted once per (tags, value, pane).  A value is unique in a window
when the panes of the window hold exactly one occurrence.  For a pane with one
occurrence the windows that cover it and neither the value's previous nor its
next pane are a contiguous range, so the pane adds +1 at the start of that
range and -1 after its end.  These events are summed per (tags, window) before
they are shuffled, and a running sum over the windows gives the counts.

The scan over a value's panes is cut into blocks of panes; only panes within a
window's length of a block's edge are copied into the neighbouring block, so a
hot value is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..operators.measures import N

#: Panes per block of the scan, as a multiple of the panes of a window, and at least.
BLOCK_WINDOWS, MIN_BLOCK = 16, 4096


def unique_events(df: DataFrame, tags, value: str, panes: int, step: int, block: int | None = None) -> DataFrame:
    """``tags, _k, _d``: how the number of unique values changes at window ``_k``.

    ``df`` has the pane number ``_p``; window ``_k`` covers panes
    ``_k * step`` to ``_k * step + panes - 1``.
    """
    tags = list(tags)
    block = max(block or max(MIN_BLOCK, BLOCK_WINDOWS * panes), panes)
    by = tags + ([value] if value not in tags else [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    p = F.col("_p")
    own = floor_div(p, block)
    near = F.array(own, F.when(p - own * block < panes, own - 1), F.when((own + 1) * block - p <= panes, own + 1))
    counts = counts.select("*", own.alias("_own"), F.explode_outer(F.filter(near, lambda b: b.isNotNull())).alias("_blk"))
    order = Window.partitionBy(*by, "_blk").orderBy("_p")
    before, after = F.lag("_p").over(order), F.lead("_p").over(order)
    counts = counts.select("*", before.alias("_before"), after.alias("_after"))
    # first panes of the windows in question: after the previous pane, no later than this one, ending before the next
    low = F.greatest(F.coalesce(F.col("_before"), p - panes), p - panes)
    high = F.least(F.coalesce(F.col("_after") - panes, p), p)
    ranges = (counts.where((F.col("_c") == 1) & (F.col("_blk") == F.col("_own")))
              .select(*tags, (floor_div(low, step) + 1).alias("_lo"), floor_div(high, step).alias("_hi")).where("_lo <= _hi"))
    events = F.array(F.struct(F.col("_lo").alias("_k"), F.lit(1).cast("long").alias("_d")),
                     F.struct((F.col("_hi") + 1).alias("_k"), F.lit(-1).cast("long").alias("_d")))
    return ranges.select(*tags, F.inline(events)).groupBy(*tags, "_k").agg(F.sum("_d").alias("_d"))


def unique_counts(windows: DataFrame, rows: DataFrame, tags, uniq, partials, panes: int, step: int) -> DataFrame:
    """The windows' partials merged per (tags, ``_k``), plus ``_uq1__u`` and ``_uqn__u`` for each column."""
    tags = list(tags)
    events = [unique_events(rows, tags, u, panes, step).withColumnRenamed("_d", f"_d__{u}") for u in uniq]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [windows, *events])
    merged = both.groupBy(*tags, "_k").agg(*[q.merged() for q in partials], *[F.sum(f"_d__{u}").alias(f"_d__{u}") for u in uniq])
    # one row per window: span / slide rows of a tag, however many rows the input has
    upto = (Window.partitionBy(*tags) if tags else Window).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for u in uniq:
        merged = merged.withColumn(f"_uq1__{u}", F.coalesce(F.sum(f"_d__{u}").over(upto), F.lit(0)).cast("long"))
        merged = merged.withColumn(f"_uqn__{u}", F.col(f"_nn__{u}"))
    # windows that only events know hold no row
    return merged.where(F.col(N).isNotNull()).drop(*[f"_d__{u}" for u in uniq])
