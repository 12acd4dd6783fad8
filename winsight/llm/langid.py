"""Language identification with word-first backoff.

A word that was seen in training is scored by its log relative frequency in
each language.  A word that was not is scored by its character n-grams: the
longest length at which any of them is known, then shorter ones.  A document's
score per language is the mean over its words.

A word or n-gram that a language does not have takes the same floor in every
language: a tenth of an occurrence in the largest one.  So a language of a few
documents does not score unseen words higher than a large one scores its own.

Counts cover every training document: tasks count words per Arrow batch,
Spark adds them up, and n-gram counts come from the word table.  Only the
model is broadcast: of every language its most frequent words and n-grams,
``max_words`` and ``max_grams`` of them, so no language loses any to another.
Entries are kept per (unit, language), not as a column per language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winsight.llm.tokens import letter_words
from winsight.llm.words import packed, unpacked
from winsight.session import materialise

#: Words and n-grams kept of each language, the most frequent ones first, ...
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
#: ... and how many entries of either kind all languages share, evenly, if they are many.
MAX_ENTRIES = 1_500_000
#: Occurrences, in the largest language, that a unit counts where it was not seen.
UNSEEN = 0.1
MAX_N = 4
#: Words of a document that count as evidence for the confidence, at most.
EVIDENCE = 24
UNKNOWN = "und"
#: Numbers of a model that a task spreads out as a table (units by languages); larger models stay as entries.
DENSE = 6_000_000
_SLICE = 10_000  # words looked up at a time


@dataclass
class LanguageModel:
    langs: list[str]
    units: list[dict[str, int]]  # words, then n-grams by length: number of each known unit
    start: np.ndarray  # where a unit's entries begin; one more than units
    lang: np.ndarray  # language of an entry
    gain: np.ndarray  # log10 relative frequency of an entry over the floor of its kind


class Scorer(dict):
    """Row of gains over the floor (a number per language) of each word of a text, for one task; a
    word gets its row when it is met first."""

    def __init__(self, model: LanguageModel, room: int = 1_200_000):
        super().__init__()
        self.model, k = model, len(model.langs)
        n = len(model.start) - 1
        self.table = None
        if n * k <= DENSE:  # every unit's row at hand; the words' come first
            self.table = np.zeros((n, k))
            self.table[np.repeat(np.arange(n), np.diff(model.start)), model.lang] = model.gain
        self.known = 0 if self.table is None else len(model.units[0])
        self.rows = np.zeros((self.known + max(2 * _SLICE, room // max(1, k)), k))
        if self.known:
            self.rows[:self.known] = self.table[:self.known]
        self._start_over()

    def _start_over(self) -> None:
        self.clear()
        if self.known:
            self.update(self.model.units[0])
        self.used = self.known

    def _mean(self, units: list[int]) -> np.ndarray:
        if self.table is not None:
            return np.add.reduce(self.table.take(units, axis=0)) / len(units)
        m, out = self.model, np.zeros(self.rows.shape[1])
        for u in units:
            s = slice(m.start[u], m.start[u + 1])
            out[m.lang[s]] += m.gain[s] / len(units)
        return out

    def __missing__(self, word: str) -> int:
        """Backoff: the word itself, else the longest known n-grams, their mean."""
        units = self.model.units
        row = self[word] = self.used
        self.used += 1
        if word in units[0]:
            self.rows[row] = self._mean([units[0][word]])
            return row
        padded = f"\x02{word}\x03"
        for n in range(min(len(units) - 1, len(padded)), 0, -1):
            get = units[n].get
            known = [r for r in [get(padded[i:i + n]) for i in range(len(padded) - n + 1)] if r is not None]
            if known:
                self.rows[row] = self._mean(known)
                return row
        self.rows[row] = 0.0
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words, langs = letter_words(text), self.model.langs
        if not words or not langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for i in range(0, len(words), _SLICE):
            if self.used + _SLICE > len(self.rows):  # full: start over
                self._start_over()
            part = words[i:i + _SLICE]
            total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        mean = total / len(words)
        # confidence: the posterior after a bounded number of words of this mean
        e = np.exp((mean - mean.max()) * math.log(10) * min(len(words), EVIDENCE))
        best = int(mean.argmax())
        return langs[best], float(e[best] / e.sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        per: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            per.setdefault(lang, Counter()).update(letter_words(text.as_py()))
        yield pa.RecordBatch.from_arrays([
            pa.array([g for g, c in per.items() for _ in c], pa.string()),
            pa.array([w for c in per.values() for w in c], pa.string()),
            pa.array([n for c in per.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])


def _cut(max_n: int):
    """n-gram counts of a batch of the word table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per: dict[tuple[str, int], dict[str, int]] = {}
            for lang, word, count in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist()):
                padded = f"\x02{word}\x03"
                for n in range(1, min(max_n, len(padded)) + 1):
                    c = per.setdefault((lang, n), {})
                    for i in range(len(padded) - n + 1):
                        g = padded[i:i + n]
                        c[g] = c.get(g, 0) + count
            yield pa.RecordBatch.from_arrays([
                pa.array([lang for (lang, _), c in per.items() for _ in c], pa.string()),
                pa.array([k for (_, k), c in per.items() for _ in c], pa.int32()),
                pa.array([g for c in per.values() for g in c], pa.string()),
                pa.array([n for c in per.values() for n in c.values()], pa.int64())], ["lang", "size", "unit", "n"])

    return cut


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
          max_grams: int = MAX_GRAMS, max_n: int = MAX_N) -> LanguageModel:
    """A model of every row with a language; rows without one are passed over."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lang-words")
    grams = counts.mapInArrow(_cut(max_n), "lang string, size int, unit string, n long")
    grams = materialise(grams.groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")), "lang-grams")
    words = counts.select("lang", F.lit(0).alias("size"), F.col("word").alias("unit"), "n")
    totals = {(r["lang"], r["size"]): r["n"] for r in words.unionByName(grams).groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}

    langs = sorted({lang for lang, _ in totals})
    share = max(1, MAX_ENTRIES // max(1, len(langs)))

    def bounded(units: DataFrame, limit: int) -> pa.Table:
        """The most frequent units of every language.  How far the bound reaches follows from how many units
        occur how often; of the last frequency a hash picks the share that fits.  Nothing is sorted."""
        limit = min(limit, share)
        often = units.groupBy("lang", F.col("n").alias("times")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("times")))
        often = often.withColumn("before", upto - F.col("c")).where(F.col("before") < limit)  # a row per frequency that has room
        least = often.groupBy("lang").agg(F.min(F.struct("times", "c", "before")).alias("x"))
        least = least.select("lang", "x.times", ((limit - F.col("x.before")) / F.col("x.c")).alias("part"))
        drawn = F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) / float(1 << 20)
        top = units.join(F.broadcast(least), "lang")  # a row per language
        top = top.where((F.col("n") > F.col("times")) | ((F.col("n") == F.col("times")) & (drawn < F.col("part"))))
        return top.select("lang", "size", "unit", "n").orderBy("size", "unit", "lang").toArrow()

    number = {lang: i for i, lang in enumerate(langs)}
    units: list[dict[str, int]] = [{} for _ in range(max_n + 1)]
    largest = [max([totals.get((lang, k), 1) for lang in langs], default=1) for k in range(max_n + 1)]
    floor = [math.log10(UNSEEN / n) for n in largest]
    start, entry_lang, gain = [], [], []
    for table in (bounded(words, max_words), bounded(grams, max_grams)):
        for lang, kind, unit, n in zip(*(table.column(c).to_pylist() for c in ("lang", "size", "unit", "n"))):
            if unit not in units[kind]:
                units[kind][unit] = len(start)
                start.append(len(gain))
            entry_lang.append(number[lang])
            gain.append(math.log10(n / totals[lang, kind]) - floor[kind])
    start.append(len(gain))
    return LanguageModel(langs, units, np.array(start, np.int64), np.array(entry_lang, np.int32), np.array(gain))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and the confidence (0 to 1).

    ``und`` with score 0 where the text is null or has no letters, and
    everywhere if nothing was learned.  Columns already called like the new
    ones are replaced.  Equal best languages: the first in order.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (lang_out, score_out)]
    held = packed(docs, _text=docs[text_col].cast("string"))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer.predict(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("_doc"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())],
                ["_doc", "_lang", "_score"])

    found = held.mapInArrow(predict, held.select("_doc").schema.add("_lang", "string").add("_score", "double"))
    return found.select(*unpacked(rest), F.col("_lang").alias(lang_out), F.col("_score").alias(score_out))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that takes no part in training; a null id takes part."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def accept(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` whose language is told with a confidence of ``least`` or more; same columns."""
    lang, score = (f"_{'_'.join(docs.columns)}_{n}" for n in ("lang", "score"))  # names that no column has
    found = identify(docs, model, text_col, lang, score)
    return found.where((F.col(f"`{lang}`") != UNKNOWN) & (F.col(f"`{score}`") >= least)).select(*[found[f"`{c}`"] for c in docs.columns])
