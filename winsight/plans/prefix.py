"""Running sums over an ordered key without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task.  Here
the order is cut into blocks of about ``block`` rows.  The cuts are order
statistics of a bounded random sample of the rows, so outliers, bursts, ties
and null keys make no block larger than its share: rows with equal keys are
told apart by ``tie_cols`` and then by a hash of the row (only rows that agree
in every column cannot be).  The sample is one aggregate, planned as a scalar
subquery; a row finds its block in three steps through the sorted cuts.

Block totals are an ordinary aggregate.  Each block then starts from one *seed
row* that carries the sum of all earlier blocks; seeds are unioned to the rows
before the window, so the rows are shuffled exactly once and nothing is joined
to them.

The sum over blocks works on the block table in two levels (groups of
``GROUP`` blocks), so no task sees more than ``GROUP`` blocks of one partition,
plus one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregate import null_safe_join

DEFAULT_BLOCK = 1 << 14
BLOCK_CONF = "spark.winsight.prefixBlockRows"
GROUP = 4096
#: Blocks at most (beyond, blocks grow with the input), and sampled rows per block.
MAX_BLOCKS, SAMPLE = 4096, 32

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _row_hash(df: DataFrame) -> Column:
    """Settles the order of rows that agree in key and ``tie_cols``."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _cut_after(at: Column, step: int):
    return lambda i: F.get("_cuts", at + i * step - 1)


def with_blocks(df: DataFrame, order_col: str, block: int, tie_cols=()) -> DataFrame:
    """Add ``_blk``, the number of sampled cuts at or below the row (nulls first), and ``_rh``, its hash."""
    df = df.withColumn("_rh", _row_hash(df))
    place = F.struct(F.col(order_col).alias("k"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_cols)], F.col("_rh").alias("h"))
    n = df.agg(F.count(F.lit(1))).scalar()
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(n / F.lit(block)))).cast("int")
    # about SAMPLE * blocks rows, drawn one by one: a row that repeats is drawn as often as chance has it
    some = df.where(F.rand(17) < F.lit(float(SAMPLE)) * blocks / F.greatest(n, F.lit(1))).select(place.alias("s"))
    drawn = some.agg(F.array_sort(F.collect_list("s")).alias("s")).select("s", F.when(F.size("s") > 0, blocks).alias("b"))
    at_share = F.transform(F.sequence(F.lit(1), F.col("b") - 1), lambda i: F.get("s", (i * F.size("s") / F.col("b")).cast("int")))
    cuts = drawn.select(F.when(F.col("b") > 1, at_share).alias("c")).scalar()
    # three steps: among the cuts 256 apart, then 16 apart, then one by one
    rows, at = df.select("*", cuts.alias("_cuts"), place.alias("_place")), F.lit(0)
    for step in (256, 16, 1):
        near = F.transform(F.sequence(F.lit(1), F.lit(16)), _cut_after(at, step))
        rows = rows.withColumn(f"_at{step}", at + step * F.size(F.filter(near, lambda c: c.isNotNull() & (c <= F.col("_place")))))
        at = F.col(f"_at{step}")
    return rows.select(*df.columns, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(at).cast("long").alias("_blk"))


def _before(totals: DataFrame, parts: list[str], values: list[str]) -> DataFrame:
    """``parts, _blk`` and ``values``: the sums over all earlier blocks."""
    t = totals.withColumn("_grp", F.floor(F.col("_blk") / GROUP))
    groups = t.groupBy(*parts, "_grp").agg(*[F.sum(v).alias(f"_g{v}") for v in values])
    over_groups = (Window.partitionBy(*parts) if parts else Window).orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*parts, "_grp", *[F.coalesce(F.sum(f"_g{v}").over(over_groups), F.lit(0)).alias(f"_g{v}") for v in values])
    inside = Window.partitionBy(*parts, "_grp").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(*parts, "_grp", "_blk", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in values])
    return null_safe_join(t, groups, parts + ["_grp"]).select(*parts, "_blk", *[(F.col(v) + F.col(f"_g{v}")).alias(v) for v in values])


def sums_over_blocks(rows: DataFrame, parts: list[str], order: list[Column], values: list[str], outs: list[str], inclusive: bool = True) -> DataFrame:
    """Running sums ``outs`` of ``values`` in ``order`` within ``parts``, for rows that carry their block ``_blk``."""
    totals = rows.groupBy(*parts, "_blk").agg(*[F.sum(v).alias(v) for v in values])
    seeds = _before(totals, parts, values).withColumn("_seed", F.lit(True))
    both = rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    inside = Window.partitionBy(*parts, "_blk").orderBy(F.col("_seed").desc(), *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    both = both.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).cast("long").alias(o) for v, o in zip(values, outs)])
    return both.where(~F.col("_seed")).drop("_seed", "_blk")


def running_sum(df: DataFrame, value: Column, order_col: str, partition_cols=(), *, inclusive: bool = True,
                out: str = "_running", block: int | None = None, tie_cols=()) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows up to this one (``inclusive``) or
    strictly before it, in ``order_col`` order within ``partition_cols``.

    ``order_col`` is a whole number (checked here).  Where it is not unique,
    ``tie_cols`` settle the order; without them the order of equal keys is
    arbitrary (but the same on every run).  Rows whose key is null come first.
    ``block`` (rows per block) defaults to the session setting
    ``spark.winsight.prefixBlockRows`` (16,384)."""
    parts = list(partition_cols)
    if not isinstance(df.schema[order_col].dataType, _INTEGRAL):
        raise TypeError(f"order column {order_col!r} must be a whole number, not {df.schema[order_col].dataType.simpleString()}")
    block = block or int(df.sparkSession.conf.get(BLOCK_CONF, str(DEFAULT_BLOCK)))
    rows = with_blocks(df, order_col, block, tie_cols).withColumn("_v", value.cast("long"))
    order = [F.col(c).asc_nulls_first() for c in [order_col, *tie_cols]] + [F.col("_rh").asc()]
    return sums_over_blocks(rows, parts, order, ["_v"], [out], inclusive).select(*df.columns, out)


def ordinal(df: DataFrame, order_col: str, partition_cols=(), *, out: str = "_rn", block: int | None = None, tie_cols=()):
    """1-based row number in ``order_col`` order."""
    return running_sum(df, F.lit(1), order_col, partition_cols, inclusive=True, out=out, block=block, tie_cols=tie_cols)
