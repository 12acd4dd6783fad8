"""Batch tagging of a record sequence (B1, B2).

Consecutive records get batch ids 1, 2, ... with sizes taken cyclically from
``sizes``; a marker is due for every *full* batch (the final partial batch
has none).  The row ordinal comes from distributed prefix sums, not from a
single-partition ``row_number``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import ordinal


def parse_sizes(text: str) -> list[int]:
    """A comma list of positive whole numbers; an error names the item that is none."""
    sizes = []
    for place, item in enumerate(str(text).split(","), start=1):
        if not re.fullmatch(r"\s*0*[1-9][0-9]*\s*", item):
            raise ValueError(f"batch size {place} of {text!r} is not a positive whole number: {item.strip()!r}")
        sizes.append(int(item))
    return sizes


def batch_of(place: Column, sizes) -> tuple[Column, Column]:
    """Number and target size of the batch that holds the row at ``place`` (from 1)."""
    sizes = list(sizes)
    cycle = sum(sizes)
    r0 = place - 1
    pos = F.pmod(r0, F.lit(cycle))
    full = ((r0 - pos) / F.lit(cycle)).cast("long")
    idx, size, bound = F, F, 0  # grown into two CASE expressions
    for i, s in enumerate(sizes):
        bound += s
        idx, size = idx.when(pos < bound, F.lit(i)), size.when(pos < bound, F.lit(s))
    return (full * len(sizes) + idx + 1).cast("long"), size.cast("long")


def assign_batches(df: DataFrame, order_col: str, sizes, partition_cols=(), *, block: int | None = None,
                   tie_cols=()) -> DataFrame:
    """B1: add ``batch_id`` (1-based) and ``batch_size`` (its target size).

    ``tie_cols`` settle the order of rows with equal ``order_col``.
    """
    kw = {"block": block} if block else {}
    d = ordinal(df, order_col, partition_cols, out="_rn", tie_cols=tie_cols, **kw)
    number, size = batch_of(F.col("_rn"), sizes)
    return d.withColumn("batch_id", number).withColumn("batch_size", size).drop("_rn")


def batch_markers(batched: DataFrame, partition_cols=()) -> DataFrame:
    """B2: one marker row (batch_id, batch_size) per full batch."""
    return (batched.groupBy(*partition_cols, "batch_id", "batch_size").agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") == F.col("batch_size")).drop("_n"))
