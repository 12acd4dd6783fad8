import random
import re
from pathlib import Path

import pytest

#: Rows that every operator has to take: nulls everywhere, empty and very long texts, ties, repeated rows.
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [
    (1, "the quick brown fox\njumps over\nthe lazy dog\nevery single day", "en", "a"),
    (1, "the quick brown fox\njumps over\nthe lazy dog\nevery single day", "en", "a"),  # repeated row
    (2, "the quick brown fox\njumps over\nthe lazy dog\nevery single day", "en", "a"),  # tie
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "fr", None),
    (6, "12 34 !!", "de", None),
    (7, LONG, "en", "c"),
    (None, "no id here", "en", "c"),
    (None, None, None, None),
    (9, "Ünïcode ÄÖÜ and İstanbul \U0001F600 text", "de", "é"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def inner_names():
    """Every name that a module of the subpackage gives to a column, but the names of results."""
    from winsight import llm
    results = {"copy", "doc_id", "text", "lang", "source"}
    found = set()
    for path in Path(llm.__file__).parent.glob("*.py"):
        if path.name != "queries.py":
            found |= set(re.findall(r"""alias\("(\w+)"|withColumn\("(\w+)"|"(_\w+)\"""", path.read_text()))
    names = {n for group in found for n in group if n}
    return sorted({n.lower(): n for n in names - results}.values())


@pytest.fixture
def edge(spark):
    """The rows above with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(EDGE, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({name: F.lit("x") for name in inner_names() if name.lower() not in {c.lower() for c in df.columns}})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def make_texts(seed: int, n: int = 60) -> list:
    """Texts out of a few passages and noise, with near copies and periodic stretches."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    passages = [noise(r.choice([150, 199, 200, 201, 250, 400, 800])) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            if r.random() < .3:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1:]
            t += noise(r.randint(0, 300)) + p[r.randint(0, 60):]
        texts.append(t)
    return texts + [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 700, "xyz" * 300, texts[3], texts[3], texts[5][10:],
                    "a" * 260 + texts[7], "Ñes " * 90 + "la " * 100]


@pytest.fixture
def texts():
    return make_texts
