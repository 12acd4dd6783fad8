"""Exact centroid clustering with heap-ordered bounds.

Every vector carries the gap between its distance to the second nearest
centroid (lower bound) and to its own (upper bound).  A round can narrow the
gap of cluster ``j`` by its own move plus the largest move of another
centroid; these narrowings add up to the drift of ``j``.  Each cluster keeps a
heap of its vectors keyed by gap plus drift at entry, so that the expired ones
stand first: a round pops the keys that the drift has passed, measures only
those vectors again and pushes them into the heap of their cluster.  An
ascending list is a heap, its expired keys are a prefix.

A block of vectors with its heaps is one row of a table that each round
writes anew; blocks report the change of the cluster sums, so the new
centroids follow from sums of a few thousand numbers.  All arithmetic that
decides a result is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winsight.session import materialise

#: Largest absolute component (after scaling) with which every distance fits a long.
LARGEST = 1 << 27
#: Vectors per block.
BLOCK = 4096
STATE = "ids array<bigint>, x binary, heap_keys binary, heap_items binary, heap_sizes array<int>, delta array<bigint>"
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("heap_keys", pa.binary()), ("heap_items", pa.binary()),
                     ("heap_sizes", pa.list_(pa.int32())), ("delta", pa.list_(pa.int64()))])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if x.shape[1] * most * most * 4 < 1 << 53:  # every sum below is a whole number that a double holds
        f, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2.0 * (f @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids.astype(np.int64)):
        out[:, j] = ((x.astype(np.int64) - c) ** 2).sum(1)
    return out


class Block:
    """Some vectors and, for each cluster, the heap of those that belong to it."""

    def __init__(self, ids: list, x: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.x, self.heaps = ids, x, heaps

    def owners(self) -> np.ndarray:
        own = np.full(len(self.x), -1, np.int32)
        for j, (_, items) in enumerate(self.heaps):
            own[items] = j
        return own

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Take out the vectors whose gap the drift has used up (with room for rounding of the bounds)."""
        gone = []
        for j, (keys, items) in enumerate(self.heaps):
            n = np.searchsorted(keys, drift[j] + 1e-6 + 1e-12 * abs(drift[j]), side="right")
            gone.append(items[:n])
            self.heaps[j] = keys[n:], items[n:]
        return np.concatenate(gone) if gone else np.empty(0, np.int32)

    def push(self, items: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Measure the vectors against every centroid and enter each into the heap of its nearest."""
        d = distances(self.x[items], centroids)
        nearest = d.argmin(1)  # the smaller number of equal ones
        upper = np.sqrt(d[np.arange(len(items)), nearest].astype(np.float64))
        if len(centroids) > 1:
            d[np.arange(len(items)), nearest] = np.iinfo(np.int64).max
            keys = np.sqrt(d.min(1).astype(np.float64)) - upper + drift[nearest]
        else:
            keys = np.full(len(items), np.inf)
        for j in np.unique(nearest):
            mine = nearest == j
            k, i = np.concatenate([self.heaps[j][0], keys[mine]]), np.concatenate([self.heaps[j][1], items[mine]])
            order = np.argsort(k, kind="stable")
            self.heaps[j] = k[order], i[order]
        return nearest

    def row(self, delta: np.ndarray) -> pa.RecordBatch:
        cols = [[self.ids], [self.x.astype("<i4").tobytes()],
                [np.concatenate([k for k, _ in self.heaps]).astype("<f8").tobytes()],
                [np.concatenate([i for _, i in self.heaps]).astype("<i4").tobytes()],
                [[len(i) for _, i in self.heaps]], [delta.ravel().tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[Block]:
    for i in range(len(batch)):  # a row at a time: a block is about a megabyte
        r = batch.slice(i, 1).to_pylist()[0]
        cuts = np.cumsum(r["heap_sizes"])[:-1]
        heaps = list(zip(np.split(np.frombuffer(r["heap_keys"], "<f8"), cuts), np.split(np.frombuffer(r["heap_items"], "<i4"), cuts)))
        yield Block(r["ids"], np.frombuffer(r["x"], "<i4").reshape(-1, dim), heaps)


def _change(k: int, x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> np.ndarray:
    """Per cluster, the change of the component sums and of the count."""
    delta = np.zeros((k, x.shape[1] + 1), np.int64)
    wide = np.concatenate([x.astype(np.int64), np.ones((len(x), 1), np.int64)], 1)
    np.add.at(delta, after, wide)
    if before is not None:
        np.subtract.at(delta, before, wide)
    return delta


def _first_round(centroids: np.ndarray, dim: int):
    def run(batches):
        k = len(centroids)
        for b in (batch.slice(at, BLOCK) for batch in batches for at in range(0, len(batch), BLOCK)):
            x = np.asarray(b.column("x").flatten(), dtype=np.int64).reshape(-1, dim).astype(np.int32)
            block = Block(b.column("ids").to_pylist(), x, [(np.empty(0), np.empty(0, np.int32)) for _ in range(k)])
            nearest = block.push(np.arange(len(x), dtype=np.int32), centroids, np.zeros(k))
            yield block.row(_change(k, x, None, nearest))

    return run


def _moved(block: Block, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """One round of a block: pop, measure, push.  The change of the cluster sums."""
    before = block.owners()
    items = block.pop(drift)
    after = block.push(items, centroids, drift) if len(items) else np.empty(0, np.int64)
    changed = before[items] != after
    return _change(len(centroids), block.x[items][changed], before[items][changed], after[changed])


def _next_round(centroids: np.ndarray, drift: np.ndarray, dim: int):
    def run(batches):
        for b in batches:
            for block in _blocks(b, dim):
                delta = _moved(block, centroids, drift)
                yield block.row(delta)

    return run


def _last_round(centroids: np.ndarray, drift: np.ndarray, dim: int):
    def run(batches):
        for b in batches:
            for block in _blocks(b, dim):
                _moved(block, centroids, drift)
                own = block.owners()
                d = np.empty(len(own), np.int64)
                for j in np.unique(own):
                    d[own == j] = distances(block.x[own == j], centroids[j:j + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(own, pa.int32()), pa.array(d)],
                                                 names=["id", "cluster", "distance"])

    return run


def _totals(state: DataFrame, k: int, dim: int) -> list[int]:
    """The blocks' changes of sums and counts, added up: ``k * (dim + 1)`` numbers."""
    rows = (state.select(F.posexplode("delta")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect())
    out = [0] * (k * (dim + 1))
    for r in rows:
        out[r["pos"]] = int(r["s"])
    return out


def _centres(totals: list[int], before: np.ndarray) -> np.ndarray:
    """Floor of sum over count, component by component; clusters without a vector stay."""
    k, dim = before.shape
    out = before.copy()
    for j in range(k):
        *sums, n = totals[j * (dim + 1):(j + 1) * (dim + 1)]
        if n:
            out[j] = [s // n for s in sums]
    return out


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``id, x``: vectors of ``dim`` finite components as whole numbers ``floor(scale * x)``."""
    v = F.transform(table[vec_col], lambda c: c.cast("double") * F.lit(float(scale)))
    rows = table.select(table[id_col].cast("long").alias("id"), v.alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGEST)))
    return (rows.where(F.coalesce((F.size("v") == dim) & fits, F.lit(False)))
            .select("id", F.transform("v", lambda c: F.floor(c)).alias("x")))


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64,
            scale: int = 64, seed: str = "1:") -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that takes part.

    Starts from the ``k`` vectors whose ``sha256(seed + id)`` is smallest;
    each of ``rounds`` rounds assigns every vector to the nearest centroid
    (squared Euclidean distance, equal ones to the smaller number) and moves
    every centroid to the floor of its vectors' mean; then vectors are
    assigned once more.  Results are those of measuring everything in every
    round.

    Defined results: vectors that are null, have another length, or hold a
    null or a component that is not finite take no part, nor do those with a
    scaled component of 2^27 or more, whose distances might not fit a long;
    with fewer than ``k`` vectors each starts a cluster; a null id reads as
    '' in the seed; repeated ids are vectors of their own (equal seeds go by
    their components); an empty table gives an empty result.  Other columns
    are ignored.
    """
    rows = whole_vectors(table, id_col, vec_col, dim, scale)
    text = F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    start = rows.orderBy(F.sha2(text, 256), "x").limit(k).collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return table.sparkSession.createDataFrame([], schema)
    centres = np.array([r["x"] for r in start], dtype=np.int64)
    k = len(centres)
    drift, totals = np.zeros(k), [0] * (k * (dim + 1))
    packed = rows.select(F.col("id").alias("ids"), "x")
    state = None
    for _ in range(rounds):
        state = materialise(packed.mapInArrow(_first_round(centres, dim), STATE) if state is None
                            else state.mapInArrow(_next_round(centres, drift, dim), STATE), "clusters")
        totals = [a + b for a, b in zip(totals, _totals(state, k, dim))]
        moved = _centres(totals, centres)
        moves = np.sqrt(((moved - centres).astype(np.float64) ** 2).sum(1))
        others = np.array([np.delete(moves, j).max(initial=0.0) for j in range(k)])
        drift, centres = drift + moves + others, moved
    if state is None:  # no round: one assignment to the first centroids
        state = packed.mapInArrow(_first_round(centres, dim), STATE)
    rows = materialise(state.mapInArrow(_last_round(centres, drift, dim), "id long, cluster int, distance long"), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = rows.agg(F.sum("distance")).scalar()
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centres])
    return rows.join(F.broadcast(sums), "cluster").select(  # a row per cluster: k at most
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"),
        F.element_at(digests, F.col("cluster") + 1).alias("centroid_sha256"))
