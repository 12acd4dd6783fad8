"""Nearest neighbours of a stated query set through a permutation index.

A vector is represented by its nearest pivots in order.  Every task holds
inverted files of its vectors, one per pivot, with the pivot's place in each
vector's order.  A query runs down the lists of its own pivots and adds up how
well the places agree, which ranks the vectors by the footrule distance of the
orders.  Vectors are then measured exactly in that ranking, in steps, until two
steps in a row bring nothing nearer than what is found.

Equal vectors are one entry of the index, with the ``k + 1`` smallest ids of
its rows: no result can name another one.  A vector that a third of all rows
share is thus one entry, and the ids of a task are cut before they are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winsight.session import materialise, scratch_path

#: Pivots of the index, and how many of them make up a vector's order (255 at most: sums of places are 16-bit).
PIVOTS, PREFIX = 512, 128
#: Vectors measured in the first step: the larger of ``LEAST`` and ``SPREAD`` times the root of the number of vectors.
LEAST, SPREAD = 200, 4.0
#: Steps in a row without a nearer vector that end the search of a block.
PATIENCE = 2
#: Vectors per inverted file, and bytes of query vectors per broadcast.
BLOCK, BROADCAST = 1 << 15, 16 << 20


def usable(vec: Column) -> Column:
    """Vectors with a component other than zero, and none that is null or not finite."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def _orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first, equal ones by number."""
    near = (pivots * pivots).sum(1)[None, :] - 2.0 * (vectors @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class InvertedFiles:
    """One block of vectors with a posting list (vector, place) per pivot."""

    def __init__(self, vectors: np.ndarray, ids: list, pivots: np.ndarray, prefix: int):
        self.vectors, self.ids, self.prefix = vectors, ids, prefix
        flat = _orders(vectors, pivots, prefix).ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vector = by_pivot // prefix
        self.place = (by_pivot % prefix).astype(np.int16)
        self.start = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def ranking(self, order: np.ndarray) -> np.ndarray:
        """Places of the block's vectors, smallest footrule distance to ``order`` first.

        A pivot missing from an order counts as standing at its end, so the
        distance falls by twice ``prefix - max(place, place)`` per shared pivot.
        """
        agree = np.zeros(len(self.vectors), np.int16)
        for place, pivot in enumerate(order):
            s = slice(self.start[pivot], self.start[pivot + 1])
            agree[self.vector[s]] += self.prefix - np.maximum(self.place[s], place)
        return np.argsort(-agree, kind="stable")

    def nearest(self, query: np.ndarray, order: np.ndarray, step: int, found: tuple, k: int) -> tuple:
        """``found`` (distances, ids; sorted) improved by this block's vectors."""
        ranked, (dists, ids), idle = self.ranking(order), found, 0
        for at in range(0, len(ranked), step):
            some = ranked[at:at + step]
            d = np.sqrt(((self.vectors[some] - query) ** 2).sum(1))
            better = np.flatnonzero(d <= dists[-1]) if len(dists) == k else np.arange(len(d))
            new = [self.ids[i] for i in some[better]]
            d = np.concatenate([dists, np.repeat(d[better], [len(x) for x in new])])
            i = np.concatenate([ids, *new])
            keep = np.lexsort((i, d))[:k]
            same = len(dists) == k and np.array_equal(i[keep], ids) and np.array_equal(d[keep], dists)
            dists, ids, idle = d[keep], i[keep], idle + 1 if same else 0
            if idle == PATIENCE:
                break
        return dists, ids


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _search(shared, total: int, prefix: int, first: int, k: int):
    """Task body: a block of vectors at a time, the best ``k`` of the task per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, numbers, queries, orders = shared.value
        found = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
        dim = pivots.shape[1]

        def blocks():
            vectors, ids, n = [], [], 0
            for b in batches:
                vectors.append(_matrix(b.column("v"), dim))
                ids += [np.asarray(x, np.int64) for x in b.column("ids").to_pylist()]
                n += len(b)
                if n >= BLOCK:
                    yield np.concatenate(vectors), ids
                    vectors, ids, n = [], [], 0
            if n:
                yield np.concatenate(vectors), ids

        for vectors, ids in blocks():
            files = InvertedFiles(vectors, ids, pivots, prefix)
            share = first * len(vectors) / total  # this block's part of the first step, and four deviations
            step = int(np.ceil(share + 4 * share ** 0.5 + 16))
            for j, q in enumerate(queries):
                found[j] = files.nearest(q, orders[j], step, found[j], k)
        for at in range(0, len(queries), 4096):
            some = found[at:at + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(numbers[at:at + 4096], [len(d) for d, _ in some])),
                 pa.array(np.concatenate([d for d, _ in some])), pa.array(np.concatenate([i for _, i in some]))],
                names=["_q", "_d", "_i"])

    return run


def nearest_neighbours(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
                       pivots: int = PIVOTS, prefix: int = PREFIX, first: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row of ``table`` where ``is_query`` holds.

    ``score`` is the Euclidean distance in double precision; equal ones go by
    id.  The pivots are ``pivots`` distinct vectors, the ones with the
    smallest hash (a bounded sample); every row is in the index.  ``first``:
    vectors measured in the first step, in place of the default.

    Defined results: null vectors, zero vectors, vectors that hold a null or
    a component that is not finite, and rows without an id take no part; rows
    that repeat an id are rows of their own; a query is never its own
    neighbour, but an equal row is; vectors of different lengths are not
    compared; with ``k`` candidates or fewer all are returned; an empty table
    gives an empty result.  Other columns are ignored.
    """
    if not 1 <= prefix <= 255:
        raise ValueError("prefix must be 1 to 255")
    spark = table.sparkSession
    rows = table.select(table[id_col].cast("long").alias("id"), table[vec_col].alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    by_vector = Window.partitionBy("v").orderBy("id")
    first_ids = rows.select("v", "id", F.row_number().over(by_vector).alias("n")).where(F.col("n") <= k + 1)
    index = materialise(first_ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = rows.where("q").select("id", "v")
    distinct = materialise(asked.groupBy("v").agg(F.count("*").alias("n")).select("v", F.monotonically_increasing_id().alias("_q")), "queries")

    out = scratch_path(spark, "neighbours")
    schema = "_q long, _d double, _i long"
    spark.createDataFrame([], schema).write.parquet(out)
    for dim, n in sorted(map(tuple, index.groupBy(F.size("v")).count().collect())):  # vectors have a few lengths
        same = index.where(F.size("v") == dim)
        chosen = same.orderBy(F.xxhash64("v"), "v").limit(max(1, min(pivots, n // 4))).select("v").collect()
        pv = np.array([r["v"] for r in chosen], dtype=np.float64)
        width = min(prefix, len(pv))
        step = first or max(LEAST, int(np.ceil(SPREAD * n ** 0.5)))
        of_dim = distinct.where(F.size("v") == dim)
        parts = -(-of_dim.count() * dim * 8 // BROADCAST)
        for part in range(parts):
            some = of_dim.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == part).collect()
            queries = np.array([r["v"] for r in some], dtype=np.float64).reshape(-1, dim)
            shared = spark.sparkContext.broadcast((pv, np.array([r["_q"] for r in some], np.int64), queries, _orders(queries, pv, width)))
            same.mapInArrow(_search(shared, n, width, step, k + 1), schema).write.mode("append").parquet(out)
            shared.unpersist()
    found = spark.read.schema(schema).parquet(out)
    near = found.select("*", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_i")).alias("_n")).where(F.col("_n") <= k + 1)
    lists = materialise(near.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("_d", "_i"))).alias("_near"))
                        .join(distinct, "_q").select("v", "_near"), "nearest")
    # its own row goes, once; where more than k + 1 rows equal the query it may not be there
    own = F.array_position(F.transform("_near", lambda x: (x["_d"] == 0) & (x["_i"] == F.col("id"))), True)
    mine = F.slice(F.filter("_near", lambda x, at: at + 1 != own), 1, k)
    ranked = asked.join(lists, "v").select(F.col("id").alias("query_id"), F.posexplode(mine).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x._i").alias("vec_id"), F.col("x._d").alias("score"))
