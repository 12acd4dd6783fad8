"""Removal of repeated byte strings by prefix-free parsing.

A byte goes when a string of ``MATCH`` bytes that covers it also starts
somewhere else.  Put in order, the suffixes of the corpus that share their
first ``MATCH`` bytes are neighbours, so only the order up to that depth is
needed.  It is never sorted byte by byte:

1. *Parse.*  A rolling hash over ``GRAM`` bytes triggers at the smallest of
   ``SPAN`` neighbours.  Every string of ``MATCH`` bytes holds one such
   trigger, at the same place in all of its occurrences.  A phrase is the run
   of starts whose strings share a trigger (``SPAN`` at most, also in text
   without variety); its dictionary word is the run and the ``MATCH - 1``
   bytes after it.
2. *Order of the parse.*  Phrases are keyed by trigger and word, dealt to
   buckets by trigger and sorted there.  Only phrases with equal triggers can
   hold equal strings.  A trigger without equal neighbour: nothing in the
   phrase is repeated.  Equal triggers and words: all of it is.
3. *Order inside phrases.*  Equal triggers under different words are the
   ragged ends of repeats.  Only there the suffixes of the words, one
   occurrence of each word, are taken start by start, cut at ``MATCH`` bytes,
   and sorted in buckets alike.

Fingerprints stand for words and suffixes: a key of 64 bits and a word of 64
bits by a second hash function.  Phrases of one trigger all have its key, so
they are told apart by the 64 bits of their words.  Texts travel once,
compressed, in blocks of a few megabytes; a block asks the buckets and gets
back the numbers of its keys that are repeated.  A key that occurs often in
one block is sent once, so the most frequent passage of the corpus costs one
row per block and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MATCH = 200
GRAM = 100
SPAN = MATCH - GRAM + 1
#: Bytes of text in a block (a longer document is a block of its own), and at work at a time.
BLOCK = 4 << 20
CHUNK = 1 << 19
_EDGE = 4 * MATCH
#: Bytes of text whose keys share a bucket, and buckets per shuffle partition at least.
BUCKET = 16 << 20
BUCKETS_PER_PARTITION = 4

_U = np.uint64
_BITS = 21  # positions inside a chunk and its edges


class _Rolling:
    """Fingerprints of any stretch of a chunk from one running sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2 ** 64, 256, dtype=_U)
        base = int(rng.integers(0, 2 ** 63)) * 8 + 5
        size = CHUNK + 2 * _EDGE + MATCH + 1
        self.up = self._powers(base, size)
        self.down = self._powers(pow(base, -1, 2 ** 64), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n, base % 2 ** 64, _U)
        p[0] = 1
        return np.multiply.accumulate(p)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.up[:len(data)], out=out[1:])
        return out

    def prints(self, sums: np.ndarray, start, end) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_ROLLING: list[_Rolling] = []


def _rolling() -> list[_Rolling]:
    if not _ROLLING:
        _ROLLING.extend([_Rolling(1), _Rolling(2)])
    return _ROLLING


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, in linear time."""
    n = len(x)
    padded = np.full(-(-n // width) * width, _U(2 ** 64 - 1))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def _phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int):
    """Phrases that begin in ``[lo, hi)`` of a block: number of starts, key of the trigger, key of the word."""
    none = np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
    a, b = max(0, lo - _EDGE), min(len(data), hi + _EDGE)
    part = data[a:b]
    if len(part) < MATCH:
        return none
    roll, other = _rolling()
    sums = roll.sums(part)
    m = len(part) - GRAM + 1
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * roll.down[:m])
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    s, e = np.maximum(starts[first:last], a) - a, np.minimum(ends[first:last], b) - a
    stop = np.repeat(e, e - s)  # the end of the document each position is in
    at = np.arange(m)
    # the smallest hash wins; of equal ones the last
    order = ((h >> _U(_BITS)) << _U(_BITS)) | (_U((1 << _BITS) - 1) - at.astype(_U))
    order[at + GRAM > stop[:m]] = _U(2 ** 64 - 1)
    low = _window_min(order, SPAN)
    valid = np.flatnonzero(np.arange(len(low)) + MATCH <= stop[:len(low)])
    if not len(valid):
        return none
    low = low[valid]
    new = np.concatenate([[True], low[1:] != low[:-1]])
    cut = np.flatnonzero(new)
    trigger = (_U((1 << _BITS) - 1) - (low[cut] & _U((1 << _BITS) - 1))).astype(np.int64)
    begin, size = valid[cut], np.diff(np.append(cut, len(valid)))
    word = other.prints(other.sums(part), begin, begin + size + MATCH - 1)
    # the word, its length and the trigger's place in it
    word = _mix(word ^ ((size * 512 + trigger - begin).astype(_U) * _U(0x9E3779B97F4A7C15)))
    core = (begin + a >= lo) & (begin + a < hi)
    return size[core], h[trigger[core]], word[core]


def _parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    parts = [_phrases(data, starts, ends, lo, min(lo + CHUNK, len(data))) for lo in range(0, len(data), CHUNK)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
    return tuple(np.concatenate(x) for x in zip(*parts))


#: What is known of a phrase: its trigger is somewhere else under other words (its
#: starts have to be looked at); its word is somewhere else; that, and its starts
#: are shown to the phrases of the first kind.
OPEN, SURE, SHOWN = 1, 2, 3


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _sort_phrases(key: np.ndarray, word: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The state of phrases that share a bucket; ``twice``: the word is known to occur twice."""
    state = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable")
    size = np.diff(np.append(np.flatnonzero(_runs(key[order])), len(key)))
    some = order[np.repeat(size, size) > 1]  # equal triggers
    some = some[np.lexsort((word[some], key[some]))]
    k, w = key[some], word[some]
    first = _runs(k, w)
    size = np.diff(np.append(np.flatnonzero(first), len(some)))
    again = (np.repeat(size, size) > 1) | np.repeat(np.logical_or.reduceat(twice[some], np.flatnonzero(first)) if len(some) else first, size)
    trigger = np.flatnonzero(_runs(k))
    words = np.add.reduceat(first.astype(np.int64), trigger) if len(some) else trigger
    mixed = np.repeat(words, np.diff(np.append(trigger, len(some)))) > 1
    state[some] = np.where(again, np.where(mixed & first, SHOWN, SURE), np.where(mixed, OPEN, 0))
    return state


def _sort_suffixes(key: np.ndarray, word: np.ndarray, _) -> np.ndarray:
    """SURE where an equal suffix shares the bucket."""
    state = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable")
    size = np.diff(np.append(np.flatnonzero(_runs(key[order])), len(key)))
    some = order[np.repeat(size, size) > 1]
    some = some[np.lexsort((word[some], key[some]))]
    size = np.diff(np.append(np.flatnonzero(_runs(key[some], word[some])), len(some)))
    state[some[np.repeat(size, size) > 1]] = SURE
    return state


def _ask(uid: str, key: np.ndarray, word: np.ndarray, buckets: int) -> Iterator[tuple]:
    """``(bucket, uid, payload)`` rows of a block: of equal pairs one is sent, marked as such.
    Bucket -1 carries what the block knows itself."""
    if not len(key):
        return
    order = np.lexsort((word, key))
    first = np.flatnonzero(_runs(key[order], word[order]))
    size = np.diff(np.append(first, len(key)))
    known = order[np.repeat(size, size) > 1].astype(np.uint32)
    if len(known):
        yield -1, uid, ((known << np.uint32(2)) | np.uint32(SURE)).tobytes()
    send, twice = order[first], size > 1
    bucket = ((key[send] >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((send, bucket))
    send, twice, bucket = send[order], twice[order], bucket[order]
    cut = np.append(np.flatnonzero(_runs(bucket)), len(bucket))
    for x, y in zip(cut[:-1], cut[1:]):
        i = send[x:y]
        number = (i.astype(np.uint32) << np.uint32(1)) | twice[x:y].astype(np.uint32)
        yield int(bucket[x]), uid, key[i].tobytes() + word[i].tobytes() + number.tobytes()


_ASK = "bucket int, uid string, payload binary"
_REPLY = "uid string, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, u, p = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(u, pa.string()), pa.array(p, pa.binary())], ["bucket", "uid", "payload"])


def _answers(batches: Iterator[pa.RecordBatch], judge) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: sort each bucket's keys and tell every block what their neighbours say."""

    def answer(asked: list[tuple[str, bytes]]) -> pa.RecordBatch:
        n = [len(p) // 20 for _, p in asked]
        key = np.concatenate([np.frombuffer(p, _U, k) for (_, p), k in zip(asked, n)])
        word = np.concatenate([np.frombuffer(p, _U, k, 8 * k) for (_, p), k in zip(asked, n)])
        number = np.concatenate([np.frombuffer(p, np.uint32, k, 16 * k) for (_, p), k in zip(asked, n)])
        state = judge(key, word, (number & np.uint32(1)) > 0)
        numbers, uids, out, at = number >> np.uint32(1), [], [], 0
        for (uid, _), k in zip(asked, n):
            own, number = state[at:at + k], numbers[at:at + k]
            at += k
            hit = np.flatnonzero(own)
            if len(hit):
                uids.append(uid)
                out.append(((number[hit] << np.uint32(2)) | own[hit]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(out, pa.binary())], ["uid", "payload"])

    now, asked = None, []
    for b in batches:
        known_u, known_p = [], []
        for bucket, uid, payload in zip(b.column("bucket").to_pylist(), b.column("uid").to_pylist(), b.column("payload").to_pylist()):
            if bucket < 0:
                known_u.append(uid)
                known_p.append(payload)
                continue
            if bucket != now and asked:
                yield answer(asked)
                asked = []
            now = bucket
            asked.append((uid, payload))
        if known_u:
            yield pa.RecordBatch.from_arrays([pa.array(known_u, pa.string()), pa.array(known_p, pa.binary())], ["uid", "payload"])
    if asked:
        yield answer(asked)


def _answered(asked: DataFrame, judge) -> DataFrame:
    """``uid, replies``: one row per block."""

    def answers(batches):
        yield from _answers(batches, judge)

    # what a block knows itself is spread by the block's name, not by its bucket
    route = F.when(F.col("bucket") < 0, F.xxhash64("uid")).otherwise(F.col("bucket").cast("long"))
    replies = asked.repartition(route).sortWithinPartitions("bucket").mapInArrow(answers, _REPLY)
    return replies.groupBy("uid").agg(F.collect_list("payload").alias("replies"))


def _states(n: int, replies) -> np.ndarray:
    state = np.zeros(n, np.uint8)
    for r in replies or ():
        x = np.frombuffer(r, np.uint32)
        at = x >> np.uint32(2)
        state[at] = np.maximum(state[at], (x & np.uint32(3)).astype(np.uint8))
    return state


def _merged(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals sorted by ``lo``, never joined across documents."""
    if not len(lo):
        return lo, hi
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], (lo[1:] > top[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


class _Block:
    """A block as the later steps see it: texts, phrases and what is known of them."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(self.lens.sum()) or 1) if len(row["text"]) else b""
        sizes = np.frombuffer(row["sizes"], np.uint8).astype(np.int64)
        # phrases lie one after the other over the starts of strings in each document
        room = np.maximum(self.lens - MATCH + 1, 0)
        before = np.cumsum(room) - room
        begin = np.cumsum(sizes) - sizes
        doc = np.searchsorted(before + room, begin, "right")
        self.lo = begin - before[doc] + self.starts[doc] if len(doc) else begin
        self.hi = self.lo + sizes
        self.state = _states(len(sizes), row["replies"])

    def open_starts(self) -> np.ndarray:
        """The starts that have to be looked at one by one, in order."""
        some = (self.state == OPEN) | (self.state == SHOWN)
        lo, size = self.lo[some], (self.hi - self.lo)[some]
        return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def suffixes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the MATCH bytes from each start on."""
        data = np.frombuffer(self.raw, np.uint8)
        key, word = np.empty(len(at), _U), np.empty(len(at), _U)
        one, two = _rolling()
        for lo in range(0, len(data), CHUNK):
            i, j = np.searchsorted(at, [lo, lo + CHUNK])
            if i < j:
                part, s = data[lo:lo + CHUNK + MATCH], at[i:j] - lo
                key[i:j] = one.prints(one.sums(part), s, s + MATCH)
                word[i:j] = two.prints(two.sums(part), s, s + MATCH)
        return key, word

    def spans(self, replies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The removed runs ``lo, hi`` and their documents."""
        sure = self.state >= SURE
        at = self.open_starts()
        at = at[_states(len(at), replies) == SURE]
        lo = np.concatenate([self.lo[sure], at])
        hi = np.concatenate([self.hi[sure], at + 1]) + MATCH - 1
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        lo, hi = _merged(lo, hi, np.searchsorted(self.ends, lo, "right"))
        return lo, hi, np.searchsorted(self.ends, lo, "right")


def _blocks(batches: Iterator[pa.RecordBatch]):
    """``uid, ids, raw, lens``: the rows of a partition in blocks, the same ones on every run."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, texts = b.column("id"), [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            yield f"{part}-{n}", ids.slice(i, j - i), b"".join(texts[i:j]), np.array([len(t) for t in texts[i:j]], np.int64)
            i, n = j, n + 1


def _of_phrases(buckets: int):
    def ask(batches):
        for uid, _, raw, lens in _blocks(batches):
            ends = np.cumsum(lens)
            _, key, word = _parse(np.frombuffer(raw, np.uint8), ends - lens, ends)
            yield _rows(list(_ask(uid, key, word, buckets)))
    return ask


def _as_blocks(batches):
    for uid, ids, raw, lens in _blocks(batches):
        ends = np.cumsum(lens)
        sizes, _, _ = _parse(np.frombuffer(raw, np.uint8), ends - lens, ends)
        yield pa.RecordBatch.from_arrays([
            pa.array([uid], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([lens.tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(raw) if raw else b""], pa.binary()),
            pa.array([sizes.astype(np.uint8).tobytes()], pa.binary())], ["uid", "ids", "lens", "text", "sizes"])


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() if c != "ids" else batch.column(c)[i].values for c in batch.schema.names}


def _of_suffixes(buckets: int):
    def ask(batches):
        for batch in batches:
            for row in _each(batch):
                block = _Block(row)
                at = block.open_starts()
                if len(at):
                    yield _rows(list(_ask(row["uid"], *block.suffixes(at), buckets)))
    return ask


def _results(with_text: bool, id_type: pa.DataType):
    def results(batches):
        for batch in batches:
            for row in _each(batch):
                block = _Block(row)
                lo, hi, doc = block.spans(row["replies2"])
                at = np.searchsorted(doc, np.arange(len(block.lens) + 1))
                removed, kept, digest = np.zeros(len(block.lens), np.int64), [], []
                for d, (s, e) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
                    out, here = [], s
                    for x, y in zip(lo[at[d]:at[d + 1]].tolist(), hi[at[d]:at[d + 1]].tolist()):
                        out.append(block.raw[here:x])
                        here = y
                        removed[d] += y - x
                    out.append(block.raw[here:e])
                    left = b"".join(out)
                    digest.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left)
                columns = [block.ids.cast(id_type), pa.array(block.lens), pa.array(removed), pa.array(np.diff(at).astype(np.int64)), pa.array(digest, pa.string())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return results


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (bytes).

    Defined results: a null text counts as empty; texts under ``MATCH`` bytes
    lose nothing; repeated rows are copies of each other; ids of any kind,
    null ones too, pass through; an empty table gives an empty result.  The
    input has to read the same on every run (a table, not an unordered
    computation), because blocks are named by partition and place.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # buckets grow with the text, so that the keys of one stay a few megabytes
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET + 1)
    blocks = rows.mapInArrow(_as_blocks, f"uid string, ids array<{kind}>, lens binary, text binary, sizes binary")
    phrases = _answered(rows.mapInArrow(_of_phrases(buckets), _ASK), _sort_phrases)
    known = blocks.join(phrases, "uid", "left")
    suffixes = _answered(known.mapInArrow(_of_suffixes(buckets), _ASK), _sort_suffixes).withColumnRenamed("replies", "replies2")
    out = known.join(suffixes, "uid", "left")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return out.mapInArrow(_results(with_text, to_arrow_type(rows.schema["id"].dataType)), schema).withColumnRenamed("id", id_col)
