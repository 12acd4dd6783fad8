"""Operators 7, 8 and 9: held-out accuracy, brute force and odd rows."""

import random
import time

import numpy as np
import pytest

from winsight.llm import langid, toxicity
from winsight.llm.licences import Matcher, scan_licences
from winsight.llm.tokens import letter_words
from winsight.llm.toxicity import segments

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------- language (8)
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.identify(docs.select("doc_id", "text", "lang", langid.held_out().alias("held_out")), model).where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in got) / len(got) > 0.98
    assert all(0 <= x.score <= 1 for x in got)


def test_words_back_off_to_shorter_ngrams(spark):
    df = spark.createDataFrame([("en", "the house the mouse"), ("de", "das haus die maus")], "lang string, text string")
    model = langid.learn(df)
    told = lambda text: langid.Scorer(model).predict(text)[0]
    assert told("the") == "en"
    assert "spouse" not in model.units[0] and told("spouse") == "en"  # through -ouse
    assert "haus" in model.units[4] and "klaus" not in model.units[0] and told("klaus") == "de"
    assert told("qqqq") in ("de", "en")  # nothing known: still an answer


def test_scores_do_not_depend_on_the_cache(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = langid.learn(docs, max_words=50, max_grams=500)
    texts = [x.text for x in docs.collect()] + [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000))]
    once, small = langid.Scorer(model), langid.Scorer(model, room=1)
    for t in texts:
        assert once.predict(t) == small.predict(t) == langid.Scorer(model).predict(t)


def brute_language(train, texts, max_n=4):
    """Word-first backoff straight from its definition: floor for what a language does not have, mean over the words."""
    import math
    from collections import Counter
    from winsight.llm.tokens import letter_words
    langs = sorted({x for x, t in train if x is not None and letter_words(t)})
    count = {(x, k): Counter() for x in langs for k in range(max_n + 1)}
    grams = lambda w, n: [f"\x02{w}\x03"[i:i + n] for i in range(len(w) + 3 - n)]
    for x, t in train:
        for w in letter_words(t) if x is not None else ():
            count[x, 0][w] += 1
            for n in range(1, max_n + 1):
                count[x, n].update(grams(w, n))
    total = {k: sum(c.values()) for k, c in count.items()}
    floor = [math.log10(0.1 / max(total[x, k] for x in langs)) for k in range(max_n + 1)]

    def unit(x, k, u):
        n = count[x, k][u]
        return (math.log10(n / total[x, k]) if n else floor[k]) - floor[k]

    def word(x, w):
        if any(count[y, 0][w] for y in langs):
            return unit(x, 0, w)
        for n in range(min(max_n, len(w) + 2), 0, -1):
            known = [g for g in grams(w, n) if any(count[y, n][g] for y in langs)]
            if known:
                return sum(unit(x, n, g) for g in known) / len(known)
        return 0.0

    out = []
    for t in texts:
        words = letter_words(t)
        if not words:
            out.append(("und", 0.0))
            continue
        mean = [sum(word(x, w) for w in words) / len(words) for x in langs]
        e = [math.exp((m - max(mean)) * math.log(10) * min(len(words), 24)) for m in mean]
        out.append((langs[e.index(max(e))], max(e) / sum(e)))
    return out


def test_language_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    train = [(x.lang, x.text) for x in docs[::3]] + [("xx", "only one odd row"), ("yy", "12 34"), (None, "no language")]
    texts = [x.text for x in docs[1::9]] + [None, "", "12", "qqqq zzzz", "only"]
    model = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    got = [langid.Scorer(model).predict(t) for t in texts]
    want = brute_language(train, texts)
    assert [x for x, _ in got] == [x for x, _ in want]
    assert np.allclose([p for _, p in got], [p for _, p in want])


def invented(r, n_words, shared=()):
    """A language: words of its own letters, Zipf frequencies, some words it shares with others."""
    letters = r.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:14]
    words = ["".join(r.choice(letters, r.integers(3, 9))) for _ in range(n_words)]
    words[5:5 + len(shared)] = shared
    p = 1 / np.arange(1, n_words + 1)
    return lambda k: [" ".join(r.choice(words, 80, p=p / p.sum())) for _ in range(k)]


@pytest.mark.parametrize("rare", [100, 10])
def test_a_rare_language_neither_takes_nor_loses_documents(spark, rare):
    """1 % and 0.1 % of the training documents: both languages are told, in both directions."""
    r = np.random.default_rng(rare)
    shared = ["la", "de", "que", "an", "no", "il"]
    large, small = invented(r, 6000, shared), invented(r, 6000, shared)
    train = [("large", t) for t in large(10_000 - rare)] + [("small", t) for t in small(rare)]
    model = langid.learn(spark.createDataFrame(train, "lang string, text string").repartition(8))
    scorer = langid.Scorer(model)
    for lang, texts in (("large", large(200)), ("small", small(200))):
        assert sum(scorer.predict(t)[0] == lang for t in texts) >= 190, lang


def test_many_languages_of_one_row(spark):
    """200 languages, 190 of them a single (mislabelled) row: the ten real ones keep their documents."""
    r = np.random.default_rng(7)
    real = [invented(r, 800) for _ in range(10)]
    train = [(f"l{i}", t) for i, f in enumerate(real) for t in f(60)] + [(f"dirt{j}", real[j % 10](1)[0]) for j in range(190)]
    model = langid.learn(spark.createDataFrame(train, "lang string, text string").repartition(4))
    assert len(model.langs) == 200
    scorer = langid.Scorer(model)
    right = [scorer.predict(t)[0] == f"l{i}" for i, f in enumerate(real) for t in f(20)]
    assert np.mean(right) >= 0.95


def test_languages_do_not_share_one_bound(spark):
    """What is kept of a language does not depend on the size of another."""
    r = np.random.default_rng(9)
    large, small = invented(r, 5000), invented(r, 300)
    train = [("large", t) for t in large(400)] + [("small", t) for t in small(20)]
    model = langid.learn(spark.createDataFrame(train, "lang string, text string"), max_words=200, max_grams=400)
    kept = {lang: sum(model.langs[x] == lang for x in model.lang) for lang in model.langs}
    assert all(540 <= kept[lang] <= 660 for lang in ("large", "small"))


def test_entries_and_table_agree(spark, monkeypatch):
    """A model too large to spread out gives the same answers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    texts = [x.text for x in docs.limit(60).collect()] + ["qqqq zzzz unheard"]
    dense = [langid.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = [langid.Scorer(model).predict(t) for t in texts]
    assert [x for x, _ in dense] == [x for x, _ in sparse] and np.allclose([p for _, p in dense], [p for _, p in sparse])


def test_language_odd_rows(edge, none, spark):
    model = langid.learn(edge)
    got = langid.identify(edge, model)
    assert set(got.columns) == {*edge.columns, "lang_pred"}  # an own column called score is replaced
    rows = got.collect()
    assert len(rows) == edge.count()
    for x in rows:
        letters = any(c.isalpha() for c in x.text or "")
        assert (x.lang_pred == "und") == (not letters) and (letters or x.score == 0)
        assert x.lang_pred in ("und", "en", "de")  # fr was given for a text without letters only
    empty = langid.learn(none)
    assert {(x.lang_pred, x.score) for x in langid.identify(edge, empty).collect()} == {("und", 0.0)}
    assert langid.accept(none, model).count() == 0
    assert {x.doc_id for x in langid.accept(edge, model).collect()} >= {1, 2, 7}


def test_letters_only():
    assert letter_words("Añb²c 1d_e") == ["añb", "c", "d", "e"]
    assert letter_words("²½") == [] and letter_words(None) == []


# ---------------------------------------------------------- toxicity (9)
def brute_segments(scores, drift):
    """All maximal scoring segments by repeated search for the best one (Ruzzo and Tompa's definition)."""
    x = [s if s else -drift for s in scores]

    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += x[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-9 or (abs(total - top[2]) <= 1e-9 and j + 1 - i < top[1] - top[0])):
                    top = (i, j + 1, total)
        return top

    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if lo < hi and (b := best(lo, hi)):
            out.append(b)
            todo += [(lo, b[0]), (b[1], hi)]
    return sorted(out)


def test_segments_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([0, 0, 0, 0, 0, -1.37, 1.11, 2.53, -0.71, 0.29]) for _ in range(r.randint(0, 25))]
        got = segments(scores, 0.173)
        want = brute_segments(scores, 0.173)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], scores
        assert all(abs(p[2] - q[2]) < 1e-9 for p, q in zip(got, want))


def test_segments_take_time_in_proportion():
    """Totals that fall and rise in turn: every candidate stays, none is looked at again and again."""
    started = time.perf_counter()
    for scores in ([1.0, -2.0] * 100_000, [2.0, -1.0] * 100_000, [1.0, -2.0, 3.0] * 60_000):
        segments(scores)
    assert time.perf_counter() - started < 5
    assert len(segments([1.0, -2.0] * 16_000)) == 16_000


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    hit = sum(x.predicted and x.toxic for x in got)
    assert hit / sum(x.toxic for x in got) > 0.8 and hit / sum(x.predicted for x in got) > 0.9
    found = [x for x in got if x.passages]
    assert found and all(0 <= p.start < p.end and p.evalue < 0.05 for x in found for p in x.passages)


def test_toxicity_odd_rows(edge, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 0), (7, 1), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.where("toxic = 5")):
        model = toxicity.learn(edge, marks)
        got = toxicity.score(edge, model).collect()
        assert len(got) == edge.count() and all(0 <= x.score <= 1 for x in got)
        assert toxicity.score(none, model).count() == 0
    assert toxicity.score(edge, toxicity.learn(none, labels)).count() == edge.count()


# --------------------------------------------------------- licences (7)
def test_notices_and_inheritance(spark):
    body = "Some words about nothing in particular, many of them, so that a notice is a small part. " * 3
    rows = [
        (1, "lib/a.py", "Licensed under the Apache License, Version 2.0.\n" + body),
        (2, "lib/LICENSE", "Released under the MIT License."),
        (3, "lib/deep/er/b.py", body),
        (4, "lib/deep/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (5, "other/c.py", body),
        (6, "lib/d.py", body + " licensed under cc by-nc 4.0"),
        (7, None, None),
        (8, "lib/deep/er/b.py", ""),
        (8, "lib/deep/er/b.py", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {x.doc_id: (x.licence, x.via) for x in scan_licences(df).collect()}
    assert got == {1: ("Apache-2.0", "header"), 2: ("MIT", "file"), 3: ("GPL-3.0", "inherited"), 4: ("GPL-3.0", "file"),
                   5: (None, "none"), 6: ("CC-BY-NC-4.0", "header"), 7: (None, "none"), 8: ("GPL-3.0", "inherited")}
    assert scan_licences(df).count() == len(rows)


def test_cosine_against_brute_force():
    import math
    from collections import Counter
    from winsight.llm.licences import TEMPLATES, words
    freq, n = {"the": 50, "license": 3, "version": 4, "under": 20}, 100
    m = Matcher(freq, n)
    vocabulary = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}
    idf = lambda w: 1 + math.log((1 + n) / (1 + freq.get(w, 0))) if w in vocabulary else 1 + math.log(1 + n)
    vec = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
    r = random.Random(1)
    pool = [*vocabulary, "foo", "bar", "baz"]
    for _ in range(200):
        base = words(r.choice([t for ts in TEMPLATES.values() for t in ts]))
        s = [w for w in base if r.random() > 0.1] + [r.choice(pool) for _ in range(r.randint(0, 3))]
        a = vec(s)
        best = max(sum(a.get(w, 0) * v for w, v in b.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                   for ts in TEMPLATES.values() for t in ts for b in [vec(words(t))]) if s else 0
        name, cosine = m.nearest(s, 0.6)
        assert (name is not None) == (best >= 0.6) and (name is None or cosine == pytest.approx(best))


def test_licences_odd_rows(edge, none):
    from pyspark.sql import functions as F
    assert scan_licences(edge.withColumn("path", F.col("source"))).count() == edge.count()
    assert scan_licences(none.withColumn("path", F.col("source"))).count() == 0
