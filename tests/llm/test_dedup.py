"""Operators 2, 3, 5 and 10 against brute force, and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from winsight.llm.components import connected
from winsight.llm.exact import drop_copies, exact_dedup
from winsight.llm.lines import dedup_lines
from winsight.llm import repeats, simhash
from winsight.llm.repeats import remove_repeats
from winsight.llm.simhash import keep_one, near_duplicates, near_links


# ------------------------------------------------------------- exact (10)
def brute_exact(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (min if keep == "min" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_exact_against_brute_force(spark, keep, ranges):
    r = random.Random(ranges)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", "", None, "ä", "prefix prefix prefix " + str(r.randint(0, 9))])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup(df, keep=keep, ranges=ranges).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == brute_exact(rows, keep)
    assert all(x.kept == (x.doc_id == x.keep_id) for x in got)


def test_exact_odd_rows(edge, none):
    got = exact_dedup(edge).collect()
    assert len(got) == edge.count()
    kept = Counter(x.text_sha256 for x in got if x.kept)
    assert set(kept.values()) == {1} and len(kept) == len({x.text_sha256 for x in got})  # one of each text, repeated rows too
    empty = [x for x in got if x.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {x.keep_id for x in empty} == {3} and len(empty) == 3
    assert exact_dedup(none).count() == 0
    assert drop_copies(edge.where("doc_id > 1")).columns == edge.columns
    folded = exact_dedup(edge, normalise=lambda t: t.substr(1, 0)).collect()
    assert {x.group_size for x in folded} == {edge.count()}


# ---------------------------------------------------- suffix arrays (2)
def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, texts, seed):
    rows = texts(seed)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df).collect()}
    assert [got[i] for i in range(len(rows))] == brute_repeats(rows)


def test_phrases_do_not_depend_on_chunks_and_blocks(texts, monkeypatch):
    data = "".join(t or "" for t in texts(5)).encode()
    whole = np.frombuffer(data, np.uint8)
    ends = np.array([len(data)])
    want = repeats._parse(whole, ends - len(data), ends)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    got = repeats._parse(whole, ends - len(data), ends)
    assert all((a == b).all() for a, b in zip(want, got))
    assert want[0].sum() == len(data) - 199 and want[0].max() <= repeats.SPAN


def test_many_surroundings_of_one_trigger_differ():
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, 1 << 18, np.uint8)
    roll = repeats._rolling()[0]
    at = int(np.argmin(repeats._mix((lambda s: (s[repeats.GRAM:] - s[:-repeats.GRAM]) * roll.down[:len(s) - repeats.GRAM])(roll.sums(letters)))))
    n = 300_000  # of so many, some are equal in 32 bits
    docs = rng.integers(97, 123, (n, 200), np.uint8)
    docs[:, 50:150] = letters[at:at + repeats.GRAM]
    ends = np.arange(1, n + 1) * 200
    sizes, key, word = repeats._parse(docs.ravel(), ends - 200, ends)
    assert sizes.sum() == n and max(Counter(key.tolist()).values()) > 0.99 * n
    assert len(np.unique(word)) == n
    assert not (repeats._sort_phrases(key, word, np.zeros(len(key), bool)) >= repeats.SURE).any()


def test_one_letter_documents(spark):
    df = spark.createDataFrame([(1, "a" * 700_000), (2, "b" * 199), (3, "c" * 200)], "doc_id long, text string")
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in remove_repeats(df).collect()} == {1: (700_000, 1), 2: (0, 0), 3: (0, 0)}


def test_repeats_across_blocks(spark, texts):
    rows = texts(9)
    r = random.Random(1)
    big = "".join(r.choice("abcdefgh ") for _ in range(5 << 20))  # a block of its own, of many chunks
    df = spark.createDataFrame([(0, big), (1, big[3_000_000:3_000_400]), *((i + 2, t) for i, t in enumerate(rows))], "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x for x in remove_repeats(df).collect()}
    assert got[1].n_removed == 400 and got[0].n_removed == 400 and got[0].n_spans == 1
    assert got[0].kept_sha256 == hashlib.sha256((big[:3_000_000] + big[3_000_400:]).encode()).hexdigest()


def test_repeats_odd_rows(edge, none):
    got = remove_repeats(edge, with_text=True).collect()
    assert len(got) == edge.count() and remove_repeats(none).count() == 0
    assert all(x.n_bytes - x.n_removed == len(x.kept) for x in got)
    assert all(x.n_removed == 0 for x in got if x.n_bytes < 200)


# ------------------------------------------------------------- lines (3)
def brute_lines(rows, window=3, divisor=4, min_lines=2):
    def chunks(text):
        lines = (text or "").split("\n")
        v = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        out, now = [], []
        for i, x in enumerate(lines):
            now.append(x)
            if i == len(lines) - 1 or sum(v[i - k] * 31 ** k for k in range(window) if i >= k) % divisor == 0:
                out.append(now)
                now = []
        return out

    seen, result = set(), {}
    for i, text in sorted(rows):
        kept = []
        for c in chunks(text):
            t = "\n".join(c)
            if len(c) >= min_lines and t.strip():
                if t in seen:
                    continue
                seen.add(t)
            kept.append(t)
        result[i] = "\n".join(kept)
    return result


def test_lines_against_brute_force(spark):
    r = random.Random(4)
    block = [f"common line {k}" for k in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 4)):
            lines += [f"own {r.random()}" for _ in range(r.randint(0, 6))]
            a = r.randint(0, 20)
            lines += block[a:a + r.randint(1, 20)]
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[5][1]), (101, "\n\n\n\n"), (102, "\n\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.text for x in dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert got[100] != rows[5][1]


def test_line_boundaries_resist_shifts(spark):
    body = "\n".join(f"line number {k}" for k in range(60))
    df = spark.createDataFrame([(1, body), (2, "new first line\n" + body)], "doc_id long, text string")
    got = {x.doc_id: x for x in dedup_lines(df).collect()}
    assert got[1]._lines_removed == 0 and got[2]._lines_removed > 40


def test_lines_odd_rows(edge, none):
    got = dedup_lines(edge).collect()
    assert len(got) == edge.count() and dedup_lines(none).count() == 0
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert by[3].text is None and by[5].text == " \t\n " and by[1].text is not None


# ----------------------------------------------------------- simhash (5)
def plain_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [0, 1, 3])
@pytest.mark.parametrize("small,split", [(12, 2048), (2, 4)])
def test_links_against_brute_force(spark, monkeypatch, bits, small, split):
    monkeypatch.setattr(simhash, "SPLIT_AT", split)
    r = random.Random(bits)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(200):  # chains and balls around them
        x = r.choice(fps)
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    centre = r.getrandbits(64)
    fps = list(dict.fromkeys(fps + [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()
    assert all(((e.a ^ e.b) & (2 ** 64 - 1)).bit_count() <= bits for e in edges)
    place = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(place[e.a]), find(place[e.b])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == roots(fps, bits)


def test_pigeonring_keys_meet_every_near_pair(spark):
    r = random.Random(7)
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(1, 3)):
            y ^= 1 << b
        ring = lambda v, s: [(v >> (56 - 8 * ((s + k) % 8))) & 255 for k in range(8)]
        assert any(sum((a ^ b).bit_count() for a, b in zip(ring(x, s)[:5], ring(y, s)[:5])) <= 1 and ring(x, s)[:2] == ring(y, s)[:2]
                   and all(sum((a ^ b).bit_count() for a, b in zip(ring(x, s)[:n], ring(y, s)[:n])) <= n * 3 // 8 for n in range(1, 9))
                   for s in range(8))


def test_simhash_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "one TWO", "ÄÖ äö", "a  b\tc\nd"]
    for _ in range(40):
        t = [r.choice(words) for _ in range(r.randint(1, 300))]
        texts.append(" ".join(t))
        for _ in range(r.randint(0, 3)):
            t = list(t)
            t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t).upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in near_duplicates(df).collect()}
    fps = [plain_simhash(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == roots(fps, 3)


def test_simhash_odd_rows(edge, none):
    got = near_duplicates(edge).collect()
    assert len(got) == edge.count() and near_duplicates(none).count() == 0
    assert {x.component_id for x in got if x.fingerprint == "0" * 16} == {3}
    assert keep_one(none).count() == 0
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 7, 9} <= set(ids) and 2 not in ids


def test_keep_one_without_ids_and_with_shared_ids(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10_000)}" for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (None, d), (None, None), (None, ""), (5, c), (5, d), (5, d), (8, c), (5, e), (3, " ")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, a), (None, b), (5, c), (5, d), (5, e), (3, " ")])


def test_components_of_a_long_path(spark):
    n = 200
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {x.node: x.root for x in connected(path).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert connected(path.where("a < 0")).count() == 0
