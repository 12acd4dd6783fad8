"""Spelling variants: words one edit apart, grouped under the commoner spelling.

Asymmetric q-chunks: the shorter word of a pair (of two equally long ones, the
smaller) contributes two disjoint chunks, its halves; the other contributes
its positional grams of those lengths.  One inserted, deleted or replaced
character leaves one of the chunks as it is, moved by the difference of the
lengths, so by one at most.  A join on (length, chunk, gram) within that shift
finds every near pair.  What the kept chunk leaves over must again keep one of
its halves, a comparison of short strings, before the edit distance is
computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winsight.llm.words import ascii_lower
from winsight.session import materialise

#: Fixed value: what separates runs of letters (lower-cased, up to U+00FF).
NOT_LETTER = "[^a-zÀ-ÿ]+"
#: Words of one chunk that a task compares with a gram's words at once; larger groups are split.
SPLIT = 2048


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3,
                slips: int | None = None) -> DataFrame:
    """``word, n``: the words of ``min_chars`` characters or more that occur ``min_count`` times or more.

    Words are the maximal runs of letters (A-Z lower-cased, U+00C0 to U+00FF
    as they are).  ``slips`` plants misspellings: where it divides the CRC-32
    ``h`` of ``<id>:<run>``, the run loses its character ``h % length``.

    Defined results: a null text has no words; a null id reads as ''.
    """
    runs = F.array_remove(F.split(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), NOT_LETTER), "")
    words = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.where(F.length("run") >= min_chars)  # a slip only shortens
    word = F.col("run")
    if slips:
        h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
        words = words.withColumn("h", h)
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slips == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = words.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _cut(text: Column, start, length) -> Column:
    """``length`` characters from the 0-based ``start`` (numbers or columns)."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.substring(text, (start + 1).cast("int"), length.cast("int"))


def _side(words: DataFrame, chunked: bool) -> DataFrame:
    """``word, n, len, longer, chunk, gram, a, b``: the two chunks of a word, or the grams that chunks of words as
    long or one shorter can meet.  ``a, b``: halves of what the chunk leaves over, aligned for the shift."""
    w, length = F.col("word"), F.length("word")
    out = []
    for longer in (0, 1):
        base = length if chunked else length - longer  # length of the chunked word
        half = F.floor((base + 1) / 2)
        shift = 0 if chunked else longer  # by how much the gram's word is longer
        for chunk in (0, 1):
            if chunk == 0:  # the first half stands at 0; the rest starts behind it
                gram, at, rest = _cut(w, 0, half), half, base - half
            else:  # the second half has moved with the end; the rest is the start
                gram, at, rest = _cut(w, half + shift, base - half), F.lit(0), half
            first = F.floor(rest / 2)
            out.append(F.struct(base.cast("int").alias("len"), F.lit(longer).alias("longer"), F.lit(chunk).alias("chunk"), gram.alias("gram"),
                                _cut(w, at, first).alias("a"), _cut(w, at + first + shift, rest - first).alias("b")))
    return words.select("word", "n", F.inline(F.array(*out)))


def near_pairs(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """``word, n, other, other_n``: every pair of different words one edit apart, once.

    ``words``: ``word, n``, each word once (read twice).  A chunk that more
    than ``split`` words share is split over as many groups as that needs;
    the grams that meet it go to each of them.
    """
    key = ["len", "longer", "chunk", "gram"]
    chunks, grams = _side(words, True), _side(words, False)
    parts = chunks.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") > split)
    parts = parts.select(*key, F.ceil(F.col("k") / split).cast("int").alias("parts"))
    chunks = chunks.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    grams = grams.join(parts, key, "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")).drop("parts")
    grams = grams.select(*[F.col(c).alias(f"other_{c}") for c in grams.columns]).withColumnRenamed("other_word", "other")
    on = [F.col(c) == F.col(f"other_{c}") for c in [*key, "part"]]
    kept = (F.col("a") == F.col("other_a")) | (F.col("b") == F.col("other_b"))
    once = (F.col("longer") == 1) | (F.col("word") < F.col("other"))
    near = reduce(Column.__and__, [*on, once, kept, F.levenshtein("word", "other", 1) == 1])
    return chunks.join(grams, near).select("word", "n", "other", "other_n").distinct()  # two chunks can find one pair


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain ``word -> form``, by doubling.  A form occurs at least twice as
    often as its word, so a chain has under 63 steps and six doublings reach its end."""
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(6):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            break
        now = now.select("word", "root")
    return now.select("word", "root")


def group_spellings(words: DataFrame, factor: int = 2, split: int = SPLIT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``).

    ``form``: of the words one edit away, the one that occurs most (equal
    ones: the smallest), if it occurs ``factor`` times as often or more;
    ``root``: the end of the chain of forms, the word itself if it has none.

    Defined results: null words and counts are left out, rows that repeat a
    word add up; an empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or chains of forms may not end")
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = materialise(words, "words")
    pairs = materialise(near_pairs(words, split), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    most = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    form_n = -F.col("best.m")
    has = form_n >= F.lit(factor) * F.col("n")
    found = materialise(most.select("word", "n_near", F.when(has, F.col("best.w")).alias("form"), F.when(has, form_n).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3,
                      slips: int | None = None) -> DataFrame:
    """:func:`group_spellings` of the :func:`word_counts` of ``docs``."""
    return group_spellings(word_counts(docs, id_col, text_col, min_chars, min_count, slips))
