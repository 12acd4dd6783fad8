"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint of 64 bits is seen as a ring of eight segments of eight bits.
If two fingerprints differ in at most ``t <= 3`` bits, some segment starts a
chain around the ring whose first ``l`` segments differ in at most
``l * t / 8`` bits, for every ``l``.  For three bits the budgets are
0, 0, 1, 1, 1, 2, 2, 3: the first two segments are equal and of the next three
at most one differs.  So a fingerprint is filed under 24 keys of 32 bits
(eight starts, times the one of the three segments left out).  Fingerprints
under one key go through the rest of the chain and then the full distance.

Equal fingerprints are one node from the start.  Keys with many fingerprints
are split further by the segments the key leaves open (one of them must be
equal, too), and from each group only a spanning forest of its links leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winsight.llm.components import connected
from winsight.session import materialise

SEGMENTS = 8
MAX_BITS = 3
SEED = 42
#: Fingerprints under one key before the key is split by a further segment.
SPLIT_AT = 2048
_PART = 65_536  # shingles turned into bits at a time
_BLOCK = 1024
_SMALL = 12


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text, unsigned; of no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and ASCII white space only
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    total = max(1, n - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    begins = np.concatenate([[0], ends[:-1]])[:total].tolist()
    ends = (ends[min(shingle, n) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _PART):
        part = min(_PART, total - at)
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(begins[at:at + part], ends[at:at + part])), np.uint64, part)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _text_key(text):
    """The MD5 of a text; of a null text: null."""
    return F.unhex(F.md5(text.cast("string")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, with_key: bool = False) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long, one row per input row; ``with_key``: and ``key``, the MD5 of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       *([_text_key(F.col(text_col)).alias("key")] if with_key else []))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, fp long" + (", key binary" if with_key else "")
    names = ["id", "fp"] + ["key"] * with_key

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), *map(b.column, names[2:])], names)

    return rows.mapInArrow(prints, schema)


def _segment(column, start: int, k: int):
    """Segment ``k`` of the chain that starts at segment ``start`` (0: the highest byte)."""
    at = (start + k) % SEGMENTS
    return F.shiftrightunsigned(column, 8 * (SEGMENTS - 1 - at)).bitwiseAND(F.lit(255))


def _keys(fps: DataFrame) -> DataFrame:
    """``fp, key`` with 24 keys per fingerprint: start, segment left out, four segments."""
    fp, keys = F.col("fp"), []
    for start in range(SEGMENTS):
        for out in (2, 3, 4):
            key = F.lit((start * 3 + out - 2) << 32)
            for place, k in enumerate(k for k in range(5) if k != out):
                key = key.bitwiseOR(F.shiftleft(_segment(fp, start, k), 8 * place))
            keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _split(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Keys in ``hot`` are replaced by four finer ones: of the four open segments
    (at most three bits apart in all) one at least is equal."""
    keys = keys.join(hot.select(F.col("key").alias("hot")), F.col("key") == F.col("hot"), "left")
    kind = F.shiftright("key", 32)
    start, out = F.floor(kind / 3), kind % 3 + 2
    finer = []
    for place, k in enumerate([out, F.lit(5), F.lit(6), F.lit(7)]):
        at = F.pmod(start + k, F.lit(SEGMENTS))
        segment = F.lit(0).cast("long")
        for s in range(SEGMENTS):
            segment = F.when(at == s, F.shiftrightunsigned("fp", 8 * (SEGMENTS - 1 - s)).bitwiseAND(F.lit(255))).otherwise(segment)
        finer.append(F.col("key").bitwiseOR(F.shiftleft(segment, 40)).bitwiseOR(F.lit((place + 1) << 48)))
    return keys.select("fp", F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.array(*finer))).alias("key"))


def _close(a: np.ndarray, b: np.ndarray, key: int | np.ndarray, bits: int) -> np.ndarray:
    """The chain's budgets from the key's start on, then the full distance."""
    x = a ^ b
    start = ((key >> 32) & 255) // 3
    turn = np.asarray(start, np.uint64) * np.uint64(8)
    ring = (x << turn) | np.where(turn > 0, x >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
    ok = np.ones(ring.shape, bool)
    for length in range(1, SEGMENTS):
        ok &= np.bitwise_count(ring >> np.uint64(64 - 8 * length)) <= length * bits // SEGMENTS
    return ok & (np.bitwise_count(x) <= bits)


def _forest(a: np.ndarray, key: int, bits: int, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside ``a``, or between ``a`` and ``b``."""
    nodes = a if b is None else np.concatenate([a, b])
    near = _close(nodes[:, None], nodes[None, :], key, bits)
    if b is not None:  # links inside a or b are found elsewhere
        near[:len(a), :len(a)] = False
        near[len(a):, len(a):] = False
    free, edges = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        if free[root]:
            free[root], todo = False, [root]
            while todo:
                u = todo.pop()
                new = np.flatnonzero(near[u] & free)
                free[new] = False
                edges += [(int(nodes[u]), int(nodes[v])) for v in new]
                todo += new.tolist()
    return edges


def _links(bits: int):
    """Per batch of rows sorted by key: the links of every group, as edges."""

    def group(key: int, fp: np.ndarray) -> list[tuple[int, int]]:
        blocks, edges = [fp[i:i + _BLOCK] for i in range(0, len(fp), _BLOCK)], []
        for i, a in enumerate(blocks):
            edges += _forest(a, key, bits)
            for b in blocks[i + 1:]:
                edges += _forest(a, key, bits, b)
        return edges

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def finish(key, fp):
            a, b = [], []
            cut = np.flatnonzero(np.diff(key)) + 1
            first = np.concatenate([[0], cut]).astype(np.int64)
            size = np.diff(np.concatenate([first, [len(key)]]))
            inner = np.repeat(size, size)
            for step in range(1, _SMALL):  # small groups: neighbours at each distance, all groups at once
                i = np.flatnonzero((inner[:-step] <= _SMALL) & (key[:-step] == key[step:])) if len(key) > step else np.empty(0, np.int64)
                if not len(i):
                    break
                i = i[_close(fp[i], fp[i + step], key[i], bits)]
                a.append(fp[i])
                b.append(fp[i + step])
            for k in np.flatnonzero(size > _SMALL):
                edges = group(int(key[first[k]]), fp[first[k]:first[k] + size[k]])
                if edges:
                    e = np.array(edges, np.uint64)
                    a.append(e[:, 0])
                    b.append(e[:, 1])
            cat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cat], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            keep = np.searchsorted(key, key[-1]) if len(key) else 0  # the last group may go on
            if keep:
                yield finish(key[:keep], fp[:keep])
            key, fp = key[keep:], fp[keep:]
        if len(key):
            yield finish(key, fp)

    return links


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: edges that connect all of the distinct ``fp`` that differ in ``max_bits`` or fewer bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be between 0 and {MAX_BITS}")
    keys = _keys(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "simhash-keys")
    keys = keys.join(sizes.select("key"), "key", "left_semi")  # lone keys link nothing
    hot = sizes.where(F.col("n") > SPLIT_AT)
    if hot.limit(1).count():
        keys = _split(keys, hot)
    keys = keys.repartition(F.col("key")).sortWithinPartitions("key", "fp")
    return keys.mapInArrow(_links(max_bits), "a long, b long").distinct()


def _classes(prints: DataFrame, first, max_bits: int) -> DataFrame:
    """``fp, first, root``: every distinct fingerprint with the aggregate ``first`` of its rows and the root of its class."""
    fps = materialise(prints.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    roots = connected(near_links(fps.select("fp"), max_bits))
    nodes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(nodes, "simhash-nodes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fingerprint, component_id``: one row per document.

    ``component_id`` is the smallest id that links lead to.  Defined results:
    null, empty and wordless texts have fingerprint zero and link to each
    other; fewer than ``shingle`` words make one shingle; repeated rows each
    get a row; null ids are passed over when the smallest is sought; an empty
    table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = _classes(prints, F.min("id"), max_bits)
    # classes of several fingerprints; a table of its own, so that the side of a large class can be split in the join
    smallest = nodes.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    smallest = materialise(smallest, "simhash-classes")
    label = nodes.join(smallest, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    out = prints.join(label, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates: the one with the smallest id.

    Null ids come last; among texts of one id the smallest MD5 decides.  Classes
    are told apart by their fingerprints, so documents without an id or with the
    same id go only if their class has another document that stays.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, with_key=True), "simhash-prints")
    nodes = _classes(prints, F.min(F.struct(F.isnull("id").alias("no_id"), "id", "key")), max_bits)
    # a table of its own, so that the side of a row that is often repeated can be split in the join
    kept = materialise(nodes.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias("_kept"), F.col("first.key").alias("_kept_key")), "simhash-kept")
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]) & _text_key(docs[text_col]).eqNullSafe(kept["_kept_key"]))
    return out.select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col, text_col])  # repeated rows
