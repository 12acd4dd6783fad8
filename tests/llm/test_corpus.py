"""Operators 1, 4 and 6 and the pipeline."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from winsight.llm import decontaminate as decontaminate_module
from winsight.llm.decontaminate import decontaminate, scan
from winsight.llm.mixing import mix_documents, plan_mix
from winsight.llm.preferences import format_preferences, swapped_answers
from winsight.llm.simhash import simhash


# ------------------------------------------------------- preferences (1)
def test_prompt_is_rendered_once(spark):
    rows = [(0, True, 0, "user", "hi"), (0, False, 0, "user", "hi"), (0, True, 1, "assistant", "good"), (0, False, 1, "assistant", "bad"),
            (1, True, 0, "user", "same"), (1, False, 0, "user", "same"), (1, False, 1, "assistant", "more"),
            (2, True, 0, None, None), (2, False, 0, None, None), (3, True, 0, "user", "alone"),
            (None, None, 0, "user", "x"), (4, True, 5, "user", "b"), (4, True, 5, "user", "a"), (4, True, 5, "user", "a")]
    df = spark.createDataFrame(rows, "p long, c boolean, turn long, role string, text string").withColumn("_side", F.lit("x"))
    got = {x.pair: x for x in format_preferences(df, F.col("p"), F.col("c")).collect()}
    x = got[0]
    assert (x.prompt_turns, x.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert x.chosen == "<|assistant|>\ngood<|end|>\n" and x.rejected == "<|assistant|>\nbad<|end|>\n"
    (s,), (t,) = x.chosen_mask, x.rejected_mask
    assert x.chosen[s.start:s.end] == "good<|end|>\n" and x.rejected[t.start:t.end] == "bad<|end|>\n"
    assert got[1].chosen == "" and got[1].prompt_turns == 1 and "more" in got[1].rejected
    assert got[2].prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen_mask == []
    assert got[None].rejected == "<|user|>\nx<|end|>\n"
    assert re.findall(r"\n(\w)<", got[4].chosen) == ["a", "a", "b"]
    assert format_preferences(df.where("p > 99"), F.col("p"), F.col("c")).count() == 0


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "q1"), (1, 1, "assistant", "x"), (1, 2, "user", "?"),
            (1, 3, "assistant", "a1"), (2, 0, "user", "no answer"), (4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (None, 0, "assistant", None)]
    turns = swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.pair: (x.prompt_turns, x.chosen, x.rejected) for x in format_preferences(turns, F.col("pair"), F.col("chosen")).collect()}
    say = lambda t: f"<|assistant|>\n{t}<|end|>\n"
    assert got == {0: (1, say("a0") + "<|user|>\nmore<|end|>\n", say("a1")), 1: (3, say("a1"), say("a0")), 2: (1, "", ""),
                   4: (1, say("a4"), ""), None: (0, say(""), "")}


# --------------------------------------------------- decontamination (4)
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, bt in items:
            b = words(bt)
            k = min(n, len(b))
            for s in range(len(b) - k + 1) if b else ():
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == b[s:s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_scan_against_brute_force(spark, limit):
    r = random.Random(1)
    pool = ["The", "quick", "é", "Ä2", "fox", "x_y", "9"]
    text = lambda k: " ".join(r.choice(pool) for _ in range(k))
    items = [(i, text(r.randint(0, 14))) for i in range(12)] + [(50, None), (51, "..."), (52, "unseen words"), (0, "fox fox fox"), (None, "quick")]
    docs = []
    for i in range(30):
        t = text(r.randint(0, 30))
        if r.random() < .5:
            t += " - " + (r.choice(items)[1] or "") + ", " + text(3)
        docs.append((i, t))
    docs += [(5, docs[5][1]), (3, "something else with the same id"), (None, docs[7][1]), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = scan(d, b, broadcast_windows=limit).collect()
    want = brute_scan(docs, [x for x in items if x[0] is not None])
    hits = brute_scan(docs, items)
    assert sorted(((x.doc_id, x.n_words, x.n_items) for x in got), key=repr) == sorted(((a, n, k) for a, n, _, k in want), key=repr)
    assert sorted(((x.doc_id, x.n_hit) for x in got), key=repr) == sorted(((a, h) for a, _, h, _ in hits), key=repr)


def test_words_stay_out_of_the_shuffled_join(spark):
    """Beyond the broadcast: no array of words in the exchange below the join of windows, no row without a hash."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    write = decontaminate_module.materialise
    try:
        decontaminate_module.materialise = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name)
        scan(d, b, broadcast_windows=0)
    finally:
        decontaminate_module.materialise = write
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = seen[-1].splitlines()
    at = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(_h#" in x and "LeftSemi" not in x)
    below = next(x for x in lines[at + 1:] if "Project" in x or "Filter" in x)
    assert "_w#" not in below and any("isnotnull(_h" in x for x in lines[at:at + 4])


def test_remove_spans_and_documents(spark, edge, none):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Say: ONE two, three four five six seven eight nine ten! Done."), (2, "one two three")], "doc_id long, text string")
    long = " ".join(["filler"] * 20_000 + ["one two three four five six seven eight nine ten"] * 2000)
    cut = decontaminate(spark.createDataFrame([(3, long)], d.schema), b, mode="spans").first().text
    assert cut.split() == ["filler"] * 20_000
    got = {x.doc_id: x.text for x in decontaminate(d, b, mode="spans").collect()}
    assert got == {1: "Say:  ," + 8 * " " + "! Done.", 2: "one two three"}
    assert [x.doc_id for x in decontaminate(d, b).collect()] == [2]
    assert decontaminate(edge, b).count() == edge.count() and decontaminate(edge, b, mode="spans").columns == edge.columns
    assert scan(none, b).count() == 0 and decontaminate(none, b).count() == 0
    assert decontaminate(edge, b.where("item_id = 0")).count() == edge.count()


# ------------------------------------------------------------ mixing (6)
def water(sizes, weights, cap=3.0):
    total, target, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a"] * 6 + ["b", "c", "é", "tiny", None])) for i in range(3000)]
    rows += [(9001, None, "a"), (9002, "", "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = plan_mix(df).collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size <= 3 * x.size
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = water(dict(size), {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)})
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == size[x.source]
    assert all(abs(taken[s] - want[s]) <= 40 for s in size), {s: (taken[s], want[s]) for s in size}
    # the rates solve the constraint, and reruns agree
    rate = defaultdict(float)
    for x in got:
        rate[x.source] += x.rate * x.size
    assert all(rate[s] == pytest.approx(want[s], rel=1e-6) for s in size if size[s])
    again = plan_mix(df.repartition(7)).collect()
    assert {(x.id, x.copies) for x in again} == {(x.id, x.copies) for x in got}


def test_mix_odd_rows(spark, edge, none):
    plan = plan_mix(edge).collect()
    assert len(plan) == edge.count() and plan_mix(none).count() == 0 and mix_documents(none).count() == 0
    mixed = mix_documents(edge)
    assert mixed.columns == [*edge.columns, "copy"]
    assert mixed.count() == sum(x.copies for x in plan)


# --------------------------------------------------------------- pipeline
def test_stages_keep_the_columns_and_drop_what_they_reject(spark, edge):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontaminate", "mix"]
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "mix":
            assert docs.columns == edge.columns
    ids = {x.doc_id for x in docs.collect()}
    assert 7 in ids and not {3, 4, 5, 6} & ids


def test_pipeline_on_planted_cases(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length("text") > 200).first()
    r = random.Random(5)
    clean = [w for x in docs.where("lang = 'en'").limit(20).collect() for w in x.text.split()]
    text = " ".join(r.choice(clean) for _ in range(300))
    # one word changed, at a place where that leaves the fingerprints within three bits
    for place in range(300):
        near = text.split()
        near[place] = "changed"
        if (simhash(" ".join(near)) ^ simhash(text)).bit_count() <= 3:
            break
    else:
        raise AssertionError("no near copy")
    rows = [(900001, text, "en", "src1", len(text)), (900002, text, "en", "src1", len(text)), (900003, " ".join(near), "en", "src1", len(text)),
            (900004, " ".join(r.choice(clean) for _ in range(200)) + " " + item.text, "en", "src1", 1), (900005, "12 34 56", "en", "src1", 8),
            (900006, " ".join(r.choice(clean) for _ in range(300)), "en", "src1", 1)]
    after = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, sf)
        kept[name] = {x.doc_id for x in after.select("doc_id").collect()}
    assert 900005 not in kept["language"] and {900001, 900006} <= kept["language"]
    assert {900001, 900006} <= kept["lines"]
    assert not {900002, 900003} & kept["near_duplicates"] and {900001, 900004, 900006} <= kept["near_duplicates"]
    assert 900004 not in kept["decontaminate"] and {900001, 900006} <= kept["decontaminate"]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 0
