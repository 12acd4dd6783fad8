"""Exact deduplication by content sort.

Sampled splitters cut the byte order of the texts into ranges, one shuffle
brings each range together, Spark's external sort puts equal texts next to
each other, and neighbouring texts are compared in full.

Equal texts that fall on both sides of a splitter are joined again through a
border table with two rows per range at most, so a group that holds a third
of all rows is spread over many ranges and never sits in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winsight.llm.words import unlike
from winsight.session import materialise

#: Sampled rows per range, and ranges per shuffle partition.
SAMPLE_PER_RANGE = 24
RANGES_PER_PARTITION = 4
PREFIX_CHARS = 16


def _splitters(rows: DataFrame, n: int) -> list[tuple]:
    """About ``n`` ordered splitters from a bounded sample: ``24 n`` keys of a few bytes reach the driver."""
    total = rows.count()
    want = SAMPLE_PER_RANGE * n
    sample = rows.select("_p", "_h", "_k")
    if total > want:
        sample = sample.sample(fraction=min(1.0, want / total), seed=11)
    # one sorted, bounded array; the order is Spark's own, the one the ranges use
    got = sample.agg(F.array_sort(F.collect_list(F.struct("_p", "_h", "_k"))).alias("s")).first()["s"]
    step = max(1, len(got) // n)
    return [tuple(r) for r in got[step::step]]


def _range_of(splitters: list[tuple]):
    """Number of splitters at or below the row's key: a coarse step, then a fine one."""
    if not splitters:
        return F.lit(0).cast("long")
    kind = "array<struct<_p:string,_h:bigint,_k:string>>"
    lit = lambda xs: F.from_json(F.lit(json.dumps([dict(zip(("_p", "_h", "_k"), x)) for x in xs])), kind)
    key = F.struct("_p", "_h", "_k")
    width = max(1, int(len(splitters) ** 0.5))
    coarse = F.size(F.filter(lit(splitters[width - 1::width]), lambda s: s <= key))
    fine = F.size(F.filter(F.slice(lit(splitters), coarse * width + 1, F.lit(width)), lambda s: s <= key))
    return (coarse * width + fine).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise=None, ranges: int | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep``: the row with the smallest (``min``) or largest (``max``) id of
    each group of equal texts stays.  ``normalise``: a function from the text
    column to the text that is compared; by default the text unchanged.

    Defined results: a null text counts as empty; an empty table gives an
    empty result; of rows that share text and id exactly one stays; a null id
    sorts below every other id and is kept only when no other id is there
    (``keep_id`` is then null).  Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_t")).select(
        "_id", "_t", F.substring("_t", 1, PREFIX_CHARS).alias("_p"), F.xxhash64("_t").alias("_h"),
        # a spread of the id, so that splitters can cut through a group of equal texts
        F.lpad(F.hex(F.xxhash64("_id")), 16, "0").alias("_k"))
    n = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_b", _range_of(_splitters(rows, n)))

    in_range = Window.partitionBy("_b").orderBy("_p", "_h", "_t", "_k", "_id")
    marked = rows.select(
        "_id", "_b", "_t", F.sha2(F.encode("_t", "UTF-8"), 256).alias("_sha"),
        (~F.lag("_t").over(in_range).eqNullSafe(F.col("_t"))).cast("long").alias("_start"),
        F.row_number().over(in_range).alias("_n"), F.lead(F.lit(1)).over(in_range).isNull().alias("_last"))
    runs = marked.select(
        "_id", "_b", "_sha", F.sum("_start").over(Window.partitionBy("_b").orderBy("_n")).alias("_run"),
        (F.col("_n") == 1).alias("_first"), "_last", F.when((F.col("_n") == 1) | F.col("_last"), F.col("_t")).alias("_edge"))
    whole = Window.partitionBy("_b", "_run")
    best = F.min("_id") if keep == "min" else F.max("_id")
    order = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    runs = runs.select("*", F.count("*").over(whole).alias("_size"), best.over(whole).alias("_best"),
                       F.row_number().over(whole.orderBy(order)).alias("_rank"))
    table = materialise(runs, "exact-runs")  # ids, digests and two texts per range

    # border runs: the first and the last run of each range, in range order
    edges = table.where(F.col("_edge").isNotNull())
    borders = edges.groupBy("_b").agg(
        F.max(F.when(F.col("_first"), F.col("_edge"))).alias("_ft"), F.max(F.when(F.col("_last"), F.col("_edge"))).alias("_lt"))
    by_range = Window.orderBy("_b")  # one row per range: a bounded table
    linked = borders.select("_b", F.lag("_lt").over(by_range).eqNullSafe(F.col("_ft")).alias("_link"))
    nodes = (edges.groupBy("_b", "_run").agg(F.max("_size").alias("_size"), F.max("_best").alias("_best"),
                                             F.max("_first").alias("_first"))
             .join(linked, "_b")
             .select("_b", "_run", "_size", "_best",
                     F.sum((~(F.col("_first") & F.col("_link"))).cast("long")).over(Window.orderBy("_b", "_run")).alias("_chain")))
    chain = Window.partitionBy("_chain")
    chained = nodes.select(
        "_b", "_run", F.sum("_size").over(chain).alias("_csize"), best_of(keep, "_best").over(chain).alias("_cbest"),
        F.row_number().over(chain.orderBy(F.col("_best").asc_nulls_last() if keep == "min" else F.col("_best").desc_nulls_last(),
                                          "_b")).alias("_crank"))
    out = table.drop("_edge", "_first", "_last").join(chained, ["_b", "_run"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_csize").isNotNull(), F.col("_cbest")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_csize", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & (F.coalesce("_crank", F.lit(1)) == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def best_of(keep: str, name: str):
    return F.min(name) if keep == "min" else F.max(name)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay (ids must be unique; see :func:`exact_dedup`)."""
    name = unlike(docs.columns, "_kept_id")
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias(name))
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")
