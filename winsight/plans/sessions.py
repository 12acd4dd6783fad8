"""Batch session windows without sorting rows per key.

Rule (Spark's ``session_window``): within a tag, ordered by time, a row starts
a new session when it lies *more* than ``gap`` after the previous row; a
distance of exactly ``gap`` merges.  Session bounds are
``[first, last + gap)``.

Cut time into buckets of width ``gap``.  Any earlier row of the same bucket
is within ``gap``, and rows two or more buckets back are always further than
``gap``.  So only the first row of a bucket can start a session, and it does
exactly when the previous *non-empty* bucket is not the adjacent one, or its
last row is more than ``gap`` before this bucket's first row.

Rows are first reduced to one partial row per (tag, bucket) with an ordinary
``groupBy`` (map-side combine keeps a hot tag cheap).  The ordered scan over
that bucket table is split into blocks of ``block`` buckets: only the last
bucket a block can have is copied into the next block, because whether a
bucket starts a session depends on the adjacent bucket alone.  No task of the
scan sees more than ``block`` (+1) buckets of one tag, however hot the tag.

Inside a block, buckets become fragments of sessions; the one before the
block's first start continues a session of an earlier block.  Its start is the
last start of the blocks before, a scan over one row per block in two levels;
only the fragments at block edges are merged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div

DEFAULT_BLOCK = 1 << 14
BLOCK_CONF = "spark.winsight.sessionBlockBuckets"
#: Blocks per group of the scan over blocks.
GROUP = 4096


def block_size(spark) -> int:
    """Buckets per block of the session scan (session setting, default 16384)."""
    return int(spark.conf.get(BLOCK_CONF, str(DEFAULT_BLOCK)))


def _join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    from .aggregate import null_safe_join
    return null_safe_join(left, right, keys)


def session_scan(buckets: DataFrame, tags, gap_us: int, block: int | None = None) -> DataFrame:
    """Add ``_blk`` and ``_sid_in`` to a (tags, _b, _tmin, _tmax, ...) table: the last
    session start of the block up to this bucket, null before the block's first start."""
    tags = list(tags)
    block = block or block_size(buckets.sparkSession)
    own = floor_div(F.col("_b"), block)
    here = F.struct(own.alias("_blk"), F.lit(False).alias("_ghost"))
    there = F.struct((own + 1).alias("_blk"), F.lit(True).alias("_ghost"))
    last = F.col("_b") == own * block + (block - 1)
    scan = buckets.select("*", F.explode_outer(F.when(last, F.array(here, there)).otherwise(F.array(here))).alias("_at"))
    scan = scan.select(*buckets.columns, "_at.*")
    in_blk = Window.partitionBy(*tags, "_blk").orderBy("_b")
    prev_b, prev_max = F.lag("_b").over(in_blk), F.lag("_tmax").over(in_blk)
    starts = ~F.col("_ghost") & (prev_b.isNull() | (prev_b < F.col("_b") - 1) | (F.col("_tmin") - prev_max > F.lit(gap_us)))
    scan = scan.withColumn("_start", F.when(starts, F.col("_tmin")))
    scan = scan.withColumn("_sid_in", F.max("_start").over(in_blk.rowsBetween(Window.unboundedPreceding, 0)))
    return scan.where(~F.col("_ghost")).drop("_ghost", "_start")


def _carried(ends: DataFrame, tags) -> DataFrame:
    """``tags, _blk, _carry``: the last session start of all earlier blocks, from ``tags, _blk, _bs``
    (a block's last start, null if it has none).

    Starts grow with time, so the last is the largest.  In two levels: blocks
    within groups of ``GROUP``, then over the groups, so no task orders more.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    t = ends.withColumn("_grp", floor_div(F.col("_blk"), GROUP))
    groups = t.groupBy(*tags, "_grp").agg(F.max("_bs").alias("_gs"))
    over = before((Window.partitionBy(*tags) if tags else Window).orderBy("_grp"))
    groups = groups.select(*tags, "_grp", F.max("_gs").over(over).alias("_gc"))
    inside = before(Window.partitionBy(*tags, "_grp").orderBy("_blk"))
    t = t.select(*tags, "_grp", "_blk", F.max("_bs").over(inside).alias("_ic"))
    return _join(t, groups, tags + ["_grp"]).select(*tags, "_blk", F.coalesce("_ic", "_gc").alias("_carry"))


def session_ids(buckets: DataFrame, tags, gap_us: int, block: int | None = None) -> DataFrame:
    """Add ``_sid`` (session start, epoch micros) to a (tags, _b, _tmin, _tmax) table."""
    tags = list(tags)
    scan = session_scan(buckets, tags, gap_us, block)
    # the last session start of all earlier blocks, for buckets before the block's first start
    carried = _carried(scan.groupBy(*tags, "_blk").agg(F.max("_sid_in").alias("_bs")), tags)
    out = _join(scan, carried, tags + ["_blk"])
    return out.withColumn("_sid", F.coalesce(F.col("_sid_in"), F.col("_carry"))).drop("_blk", "_sid_in", "_carry")


def session_totals(buckets: DataFrame, tags, gap_us: int, partials, block: int | None = None) -> DataFrame:
    """``tags, _sid`` and the buckets' partials merged per session.

    A session that starts and ends within a block is whole there.  Only what
    touches a block's edge, the part before its first start and the one from
    its last, is looked up and merged again: two rows per block.
    """
    tags = list(tags)
    names = [p.name for p in partials]
    scan = session_scan(buckets, tags, gap_us, block)
    scan = scan.withColumn("_bs", F.max("_sid_in").over(Window.partitionBy(*tags, "_blk")))
    fragments = scan.groupBy(*tags, "_blk", "_sid_in", "_bs").agg(*[p.merged() for p in partials])
    at_edge = F.col("_sid_in").isNull() | (F.col("_sid_in") == F.col("_bs"))
    whole = fragments.where(~at_edge).select(*tags, F.col("_sid_in").alias("_sid"), *names)
    edges = fragments.where(at_edge)
    carried = _carried(edges.groupBy(*tags, "_blk").agg(F.max("_bs").alias("_bs")), tags)
    edges = _join(edges, carried, tags + ["_blk"]).withColumn("_sid", F.coalesce("_sid_in", "_carry"))
    return whole.unionByName(edges.groupBy(*tags, "_sid").agg(*[p.merged() for p in partials]))
