"""Operators 11 to 13 against brute force, and on odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from oracle import compare, duck
from pyspark.sql import functions as F
from winsight.llm import neighbours
from winsight.llm import queries as Q
from winsight.llm.centroids import Block, cluster, distances
from winsight.llm.neighbours import nearest_neighbours
from winsight.llm.spelling import group_spellings, near_pairs, spelling_variants, word_counts

SF = "/root/testdata/sf0.1"


# ---------------------------------------------------- neighbours (11)
def brute_neighbours(rows, k=10):
    """``rows``: (id, vector); every row but the query's own, by distance, then id."""
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(ok):
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))
            out.setdefault(i, []).append(d[:k])
    return out


def found(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: sorted(x) for q, x in rows.items()}


def by_hundreds():
    return F.pmod("vec_id", F.lit(100)) == 0


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(Q.queries()["op11_neighbours"](spark, SF))
    assert got.keys() == want.keys() and all([r[0] for r in x] == list(range(1, 11)) for x in got.values())
    hits = sum(len({r[2] for r in got[q]} & {i for _, i in want[q][0]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, x in got.items():
        assert [(s, i) for _, s, i in x] == sorted((s, i) for _, s, i in x)


def test_neighbours_with_every_vector_measured(spark):
    """Copies, ties, repeated ids, odd vectors and several lengths: exact where the first step covers all."""
    r = random.Random(3)
    base = [[float(r.randint(-3, 3)) for _ in range(4)] for _ in range(30)]
    rows = [(i, r.choice(base)) for i in range(700)] + [(100, base[0]), (100, base[1]), (200, base[2])]
    rows += [(1000 + 100 * i, base[5]) for i in range(40)]  # more equal queries than a result has places
    rows += [(5000, None), (5100, []), (5200, [0.0] * 4), (5300, [1.0, None, 0.0, 0.0]), (5400, [float("nan"), 1.0, 1.0, 1.0]),
             (5500, [float("inf"), 1.0, 1.0, 1.0]), (None, base[3]), (None, None), (6000, [1.0, 2.0]), (6001, [2.0, 2.0]), (7000, [9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    table = table.withColumns({n: F.lit("x") for n in ("id", "v", "q", "_q", "_d", "_i", "ids", "n", "_near", "rank")})
    got = {}
    for x in nearest_neighbours(table, by_hundreds(), first=10_000).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.score, x.vec_id))
    want = {q: x for q, x in brute_neighbours(rows).items() if any(x)}
    for q, lists in want.items():
        expect = sorted((n + 1, d, i) for one in lists for n, (d, i) in enumerate(one))
        assert sorted(got.pop(q)) == expect, q
    assert not got
    assert [x[2] for x in found(nearest_neighbours(table, F.col("vec_id") == 6000))[6000]] == [6001]  # all there are


def test_neighbours_stop_early_only_when_nothing_comes(spark):
    """A dense group larger than the first step: its nearest are still found."""
    r = np.random.default_rng(5)
    centre, noise = r.normal(size=16), r.normal(size=(1500, 16))
    data = np.concatenate([centre + 1e-3 * r.normal(size=(1500, 16)), noise])
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    want = brute_neighbours(rows)
    got = found(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), by_hundreds()))
    hits = sum(len({x[2] for x in got[q]} & {i for _, i in want[q][0]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_footrule():
    """The sums over inverted files rank like the footrule distance of the orders."""
    r = np.random.default_rng(1)
    data, pivots = r.normal(size=(200, 8)), r.normal(size=(24, 8))
    files = neighbours.InvertedFiles(data, [np.array([i]) for i in range(200)], pivots, 10)
    orders = neighbours._orders(data, pivots, 10)
    place = np.full((200, 24), 10)
    np.put_along_axis(place, orders, np.arange(10)[None].repeat(200, 0), 1)
    for q in (0, 7, 99):
        foot = np.abs(place - place[q]).sum(1)
        assert (np.diff(foot[files.ranking(orders[q])]) >= 0).all()


def test_neighbours_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours(none, by_hundreds()).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest_neighbours(one, by_hundreds()).count() == 0


def test_neighbours_query_batches(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = found(nearest_neighbours(table, by_hundreds()))
    monkeypatch.setattr(neighbours, "BROADCAST", 2 * 64 * 8)
    assert found(nearest_neighbours(table, by_hundreds())) == whole


# ------------------------------------------------------ clusters (12)
def brute_clusters(rows, k, rounds, dim, scale=64, seed="1:"):
    import hashlib
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(scale * x) < 1 << 27 for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(kept, own) if o == j))] or c for j, c in enumerate(cs)]
    out = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, j in out:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i is None, i or 0, j, d, per[j], sum(per.values()), digest[j]) for i, d, j in out)


def clusters(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r["cluster"], r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,k,rounds", [(1, 16, 3), (2, 5, 8), (3, 1, 2), (4, 16, 0)])
def test_clusters_against_brute_force(spark, seed, k, rounds):
    r = np.random.default_rng(seed)
    data = np.round(r.normal(size=(900, 6)) + 3 * r.integers(0, 3, size=(900, 1)), 1)  # ties and copies
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5, [0.5] * 6), (None, [0.25] * 6), (None, [-0.25] * 6)]
    rows += [(9001, None), (9002, []), (9003, [1.0] * 5), (9004, [None] * 6), (9005, [float("nan")] * 6), (9006, [float("inf")] * 6), (9007, [1e300] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    df = df.withColumns({n: F.lit("x") for n in ("id", "x", "ids", "cluster", "distance", "delta", "v")})
    assert clusters(cluster(df, k=k, rounds=rounds, dim=6)) == brute_clusters(rows, k, rounds, 6)


def test_clusters_of_few_and_none(spark):
    rows = [(3, [1.0, 2.0]), (4, [5.0, 2.0]), (4, [5.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(cluster(df, dim=2)) == brute_clusters(rows, 16, 3, 2)
    assert cluster(df.where("vec_id = 0"), dim=2).count() == 0


def test_cluster_distances_stay_whole_numbers():
    r = np.random.default_rng(0)
    x = r.integers(-(1 << 27) + 1, 1 << 27, size=(50, 64)).astype(np.int32)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in x[:3]] for v in x]
    assert distances(x, x[:3].astype(np.int64)).tolist() == want
    small = r.integers(-40, 40, size=(50, 64)).astype(np.int32)
    assert distances(small, small[:3].astype(np.int64)).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in small[:3]] for v in small]


def test_heaps_leave_settled_vectors_alone():
    """Only vectors whose gap the drift has used up are measured again."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-50, 50, size=(500, 8)), 10_000 + r.integers(-50, 50, size=(500, 8))]).astype(np.int32)
    centres = np.array([[0] * 8, [10_000] * 8], np.int64)
    block = Block(list(range(1000)), x, [(np.empty(0), np.empty(0, np.int32)) for _ in range(2)])
    block.push(np.arange(1000, dtype=np.int32), centres, np.zeros(2))
    assert all((np.diff(k) >= 0).all() for k, _ in block.heaps)
    assert len(block.pop(np.array([30.0, 30.0]))) == 0 and len(block.pop(np.array([1e6, 0.0]))) == 500


# ------------------------------------------------------ spellings (13)
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spellings(count, factor=2):
    out, form = {}, {}
    for w, n in count.items():
        some = [(-m, v) for v, m in count.items() if near(w, v)]
        best = min(some, default=None)
        form[w] = best[1] if best and -best[0] >= factor * n else None
        out[w] = [n, len(some), -best[0] if form[w] else None]
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def spellings(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed,split", [(1, 2048), (2, 3), (3, 1)])
def test_spellings_against_brute_force(spark, seed, split):
    r = random.Random(seed)
    letters = "abé"
    count = {"".join(r.choice(letters) for _ in range(r.randint(5, 7))): 3 * 2 ** r.randint(0, 9) for _ in range(160)}
    count |= {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "ababab": 7, "bababa": 7, "Ünicode": 9, "Unicode": 30}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert spellings(group_spellings(df, split=split)) == brute_spellings(count)
    pairs = {tuple(sorted((x.word, x.other))) for x in near_pairs(df, split).collect()}
    assert pairs == {(a, b) for a in count for b in count if a < b and near(a, b)}


def test_word_counts_against_brute_force(spark, edge):
    import re
    rows = [(x.doc_id, x.text) for x in edge.collect()]
    count = Counter()
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 5 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 4:
                count[run] += 1
    got = {x.word: x.n for x in word_counts(edge, min_chars=4, min_count=1, slips=5).collect()}
    assert got == count
    assert spellings(spelling_variants(edge, min_count=2)) == brute_spellings(
        {x.word: x.n for x in word_counts(edge, min_count=2).collect()})


def test_spellings_odd_rows(spark, none):
    assert spelling_variants(none).count() == 0
    odd = spark.createDataFrame([("house", 2), ("house", 3), ("houses", 10), (None, 4), ("mouse", None)], "word string, n long")
    assert spellings(group_spellings(odd)) == {"house": ("houses", "houses", 5, 1, 10), "houses": (None, "houses", 10, 1, None)}
    with pytest.raises(ValueError):
        group_spellings(odd, factor=1)


def test_chains_end_at_the_commonest(spark):
    chain = {"a" * (5 + i): 3 * 2 ** i for i in range(40)}
    got = spellings(group_spellings(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {x[1] for x in got.values()} == {"a" * 44}


@pytest.mark.parametrize("name", ["op12_clusters", "op13_spellings"])
def test_oracles_on_a_larger_table(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(Q.queries()[name](spark, sf), duck(sf), Q.oracle_sql()[name]) == []
