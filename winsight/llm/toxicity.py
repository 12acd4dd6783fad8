"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are scored by the log-odds of toxic against clean documents under an
informative Dirichlet prior (the token's share of the whole corpus); a word
takes the score of its most significant unit, itself or one of its prefixes.
Neutral tokens cost a little, so a passage of toxic tokens stands out as a
maximum-scoring segment; one linear scan finds all of them.  Segment scores
are put on a common scale by the Karlin-Altschul extreme-value law (chance
grows with the length of the text), and a logistic fit of these scores on the
training labels gives the final score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winsight.llm.tokens import Bounded, letter_words
from winsight.session import materialise

#: Bounds: scored units, and labelled training documents (16 bytes each are broadcast).
MAX_UNITS = 50_000
MAX_TRAIN = 400_000
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the prior in documents, least significance of a unit, cost of a neutral token.
PRIOR = 20.0
LEAST_Z = 3.0
DRIFT = 0.01
THRESHOLD = 0.3


def segments(scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last + 1, score)`` of a sequence in
    which zeros count as ``-drift``; time linear in the sequence."""
    total, at = 0.0, 0
    # first, end, total before, total after, nearest earlier candidate with a smaller total before (-1: none)
    found: list[tuple[int, int, float, float, int]] = []
    for i, s in enumerate(scores):
        if s == 0.0:
            continue
        total -= drift * (i - at)
        at = i + 1
        if s < 0:
            total += s
            continue
        first, before, after, j = i, total, total + s, len(found) - 1
        total = after
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]  # whatever lies between has no smaller total either
            if j < 0 or found[j][3] >= after:
                found.append((first, i + 1, before, after, j))
                break
            first, _, before, _, earlier = found[j]
            del found[j:]
            j = earlier
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class ToxicModel:
    units: dict[str, tuple[float, float]] = field(default_factory=dict)  # unit -> (log-odds, z)
    scale: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    weights: tuple = (-3.0, 0.0, 0.0)  # logistic: intercept, best passage, all passages
    drift: float = DRIFT

    def word(self, word: str) -> float:
        """The score of the most significant unit of a word; 0 if it has none."""
        best = self.units.get(word)
        for n in PREFIXES:
            if n <= len(word) and (u := self.units.get("^" + word[:n])) and (best is None or abs(u[1]) > abs(best[1])):
                best = u
        return best[0] if best else 0.0

    def passages(self, text: str | None, cache: Bounded) -> tuple[int, list[tuple[int, int, float]]]:
        words = letter_words(text)
        scores = list(map(cache.__getitem__, words))
        return len(words), segments(scores, self.drift) if any(scores) else []

    def features(self, text: str | None, cache: Bounded) -> tuple[float, float, int, list]:
        """Extreme-value scores of the best passage and of all, in nats over chance."""
        n, found = self.passages(text, cache)
        chance = self.log_k + math.log(max(n, 1))
        best = max((s for _, _, s in found), default=0.0)
        return self.scale * best - chance, self.scale * sum(s for _, _, s in found) - chance, n, found

    def score(self, best: float, every: float) -> float:
        a, b, c = self.weights
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * max(best, -10.0) + c * max(every, -10.0)))))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that takes no part in training; a null id takes part."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word: all, toxic, clean."""
    for b in batches:
        every, toxic, clean = Counter(), Counter(), Counter()
        for y, text in zip(b.column("y").to_pylist(), b.column("text")):
            words = set(letter_words(text.as_py()))
            every.update(words)
            if y is not None:
                (toxic if y else clean).update(words)
        words = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (every, toxic, clean))],
            ["word", "every", "toxic", "clean"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_train: int = MAX_TRAIN, max_units: int = MAX_UNITS) -> ToxicModel:
    """Learn from the labelled documents outside the held-out fold.

    Of more than ``max_train`` labelled rows a seeded sample of about that size
    is used, so that what is broadcast and fitted stays bounded.  Null labels
    are passed over; of several labels of one id the largest counts.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where(F.col("y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    marks = materialise(marks, "toxic-labels")
    n = marks.count()
    if n > max_train:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(marks), F.col("id") == F.col("_id"), "left").select("text", "y")
    words = marked.mapInArrow(_counted, "word string, every long, toxic long, clean long")
    words = materialise(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("every", "toxic", "clean")]), "toxic-words")
    prefixes = F.transform(F.filter(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: k <= F.length("word")),
                           lambda k: F.concat(F.lit("^"), F.substring("word", F.lit(1), k)))
    units = words.select(F.explode(F.concat(F.array("word"), prefixes)).alias("unit"), "every", "toxic", "clean")
    units = units.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("every", "toxic", "clean")])
    # log-odds with the corpus as prior, and their z-values
    size = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("every", "toxic", "clean")]).first()
    share = F.col("every") / float(max(size["every"], 1))
    mass = PRIOR * max(size["toxic"], 1) / max(marks.where("y = 1").count(), 1)  # PRIOR documents of average length
    prior = share * mass + 0.01
    side = lambda c: F.log((F.col(c) + prior) / (F.lit(float(size[c] + mass)) - F.col(c) - prior))
    odds = side("toxic") - side("clean")
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = units.where("toxic + clean > 0").select("unit", odds.alias("odds"), z.alias("z"), "clean")
    kept = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "unit").limit(max_units).toPandas()
    model = ToxicModel({u: (float(o), float(v)) for u, o, v in zip(kept["unit"], kept["odds"], kept["z"])})

    # the training documents' passages: the law's constants and the final fit
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = Bounded(m.word)
        for b in batches:
            got = [m.passages(t.as_py(), cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([max((s for *_, s in f), default=0.0) for _, f in got], pa.float64()),
                 pa.array([sum(s for *_, s in f) for _, f in got], pa.float64()),
                 pa.array([n for n, _ in got], pa.int64()), b.column("y")], ["best", "every", "n", "y"])

    train = rows.join(F.broadcast(marks), F.col("id") == F.col("_id")).select("text", "y")
    seen = train.mapInArrow(measured, "best double, every double, n long, y int").toPandas()
    y = seen["y"].to_numpy(float)
    if not len(seen) or y.min() == y.max():
        rate = float(y.mean()) if len(seen) else 0.05
        model.weights = (math.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0)
        return model
    length = np.log(np.maximum(seen["n"].to_numpy(float), 1))
    clean = y == 0
    # scores are log-odds, so the law's lambda is close to 1; K by maximum likelihood over clean documents
    model.log_k = float(-np.log(np.mean(np.exp(-(seen["best"].to_numpy()[clean] * model.scale - length[clean])))))
    chance = model.log_k + length
    x = np.column_stack([np.maximum(seen["best"].to_numpy() * model.scale - chance, -10), np.maximum(seen["every"].to_numpy() * model.scale - chance, -10)])
    model.weights = tuple(float(v) for v in _logistic(x, y))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", level: float = 0.05) -> DataFrame:
    """``id_col, score, predicted, passages``: passages are the segments that
    chance explains in less than ``level`` of texts of that length, as word
    positions ``start, end`` with ``score`` and ``evalue``.

    A null or wordless text has no passage and the score of a text without
    any; repeated rows each get a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    name = id_col
    shared = spark.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = Bounded(m.word)
        for b in batches:
            value, spans = [], []
            for t in b.column("_text"):
                best, every, n, found = m.features(t.as_py(), cache)
                value.append(m.score(best, every))
                law = [(a, e, s, math.exp(min(50.0, m.log_k + math.log(max(n, 1)) - m.scale * s))) for a, e, s in found]
                spans.append([dict(start=a, end=e, score=s, evalue=v) for a, e, s, v in law if v < level])
            yield pa.RecordBatch.from_arrays(
                [b.column(name), pa.array(value, pa.float64()), pa.array([int(v >= THRESHOLD) for v in value], pa.int32()),
                 pa.array(spans, pa.list_(passage))], [name, "score", "predicted", "passages"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scored, f"`{name}` {kind}, score double, predicted int, "
                                   "passages array<struct<start:int,end:int,score:double,evalue:double>>")
