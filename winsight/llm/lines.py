"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of the last three lines decides after which
line a chunk ends, so the same passage falls into the same chunks wherever it
stands.  Chunks of two lines or more whose digest occurs again anywhere are
compared byte for byte with the first occurrence and then removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winsight.session import materialise

#: Lines under the rolling hash, and one boundary in so many lines on average.
WINDOW = 3
DIVISOR = 4
_BASE = 31


def _chunks(text: Column, lines: str, window: int, divisor: int, values: str, ends: str) -> list:
    """The successive columns: lines -> values -> chunk ends -> chunks."""
    value = F.transform(lines, lambda x: F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 7), 16, 10).cast("long"))

    def closes(i):
        rolled = F.lit(0).cast("long")
        for k in range(window):
            there = F.when(i > k, F.element_at(values, F.greatest(i - k, F.lit(1)))).otherwise(0)
            rolled = rolled + there * (_BASE ** k)
        return (i == F.size(values)) | (rolled % divisor == 0)

    end = F.filter(F.sequence(F.lit(1), F.size(values)), closes)
    chunk = F.transform(ends, lambda e, k: F.array_join(
        F.slice(lines, F.when(k == 0, 1).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1),
                e - F.when(k == 0, 0).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))))), "\n"))
    size = F.transform(ends, lambda e, k: e - F.when(k == 0, 0).otherwise(F.element_at(ends, F.greatest(k, F.lit(1)))))
    return [value, end, chunk, size]


def line_chunks(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` plus ``_id, _key, _chunks, _sizes``: every text as its chunks and their line counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select("*", F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), F.split(text, "\n", -1).alias("_lines"))
    value, end, chunk, size = _chunks(text, "_lines", window, divisor, "_values", "_ends")
    out = out.withColumn("_values", value).withColumn("_ends", end).withColumn("_chunks", chunk).withColumn("_sizes", size)
    # one row again: a filter on what is made of the chunks must not be pushed below them, where each
    # lambda would work out all the arrays it refers to once per element
    both = F.explode_outer(F.array(F.struct("_chunks", "_sizes"))).alias("_both")
    return out.drop("_lines", "_values", "_ends").withColumn("_both", both).drop("_chunks", "_sizes").select("*", "_both._chunks", "_both._sizes").drop("_both")


def _removals(docs: DataFrame, id_col: str, text_col: str, window: int, divisor: int, min_lines: int) -> DataFrame:
    """``_id, _key, _gone``: the 1-based chunks of each document that repeat an earlier chunk."""
    thin = docs.select(F.col(id_col), F.col(text_col))
    chunked = line_chunks(thin, id_col, text_col, window, divisor)
    # outer: the array is never empty, and a plain explode would add a filter that works out the chunks a second time
    each = chunked.select("_id", "_key", "_sizes", F.posexplode_outer("_chunks").alias("_at", "_text"))
    each = each.where((F.element_at("_sizes", F.col("_at") + 1) >= min_lines) & F.col("_text").rlike(r"\S"))
    places = materialise(each.select("_id", "_key", (F.col("_at") + 1).alias("_at"), F.unhex(F.md5(F.encode("_text", "UTF-8"))).alias("_d")), "line-chunks")
    repeated = places.groupBy("_d").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_key", "_at")).alias("_first")).where("_n > 1").drop("_n")
    # a table of its own, so that both sides of the join are plain shuffles and a hot chunk's side can be split
    repeated = materialise(repeated, "line-repeated")
    later = (places.join(repeated, "_d").where(~F.struct("_id", "_key", "_at").eqNullSafe(F.col("_first"))))
    later = materialise(later.select("_d", "_id", "_key", "_at"), "line-later")
    firsts = repeated.join(later.select("_d").distinct(), "_d", "left_semi")
    # the bytes of both sides: one row per document with the chunks that are asked for
    asked = later.select("_id", "_key", "_at", "_d", F.lit(False).alias("_head")).unionByName(
        firsts.select("_first._id", "_first._key", "_first._at", "_d", F.lit(True).alias("_head")))
    asked = asked.groupBy(F.col("_id").alias("_aid"), F.col("_key").alias("_akey")).agg(
        F.collect_set(F.struct("_at", "_d", "_head")).alias("_asked"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with_key = thin.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.xxhash64(text).alias("_k"))
    with_key = with_key.join(asked, F.col("_i").eqNullSafe(F.col("_aid")) & (F.col("_k") == F.col("_akey"))).select("_i", "_t", "_asked")
    found = line_chunks(with_key, "_i", "_t", window, divisor)
    found = found.select("_id", "_key", "_chunks", F.explode_outer("_asked").alias("_a")).select(
        "_id", "_key", F.col("_a._at").alias("_at"), F.col("_a._d").alias("_d"), F.col("_a._head").alias("_head"),
        F.element_at("_chunks", F.col("_a._at")).alias("_text"))
    found = materialise(found, "line-bytes")
    heads = found.where("_head").select("_d", F.col("_text").alias("_head_text")).dropDuplicates(["_d"])
    gone = found.where(~F.col("_head")).join(heads, "_d").where(F.col("_text") == F.col("_head_text"))
    return gone.groupBy(F.col("_id").alias("_gid"), F.col("_key").alias("_gkey")).agg(F.collect_set("_at").alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                divisor: int = DIVISOR, min_lines: int = 2,
                counts: tuple[str, str, str] = ("_n_lines", "_lines_removed", "_chunks_removed")) -> DataFrame:
    """``docs`` with repeated chunks removed from the text, plus ``counts``: lines, lines and chunks removed.

    The first occurrence (smallest id, then place in the document) stays.
    Defined results: a null text stays null; chunks of fewer than
    ``min_lines`` lines or without a visible character are never removed;
    rows that share id and text count as one place, so none of their chunks is
    removed because of the other; an empty table gives an empty result; own
    columns called like ``counts`` are replaced.
    """
    rest = [c for c in docs.columns if c != text_col]
    gone = _removals(docs, id_col, text_col, window, divisor, min_lines)
    # the other columns in one, so that no name of theirs can clash
    held = docs.select(F.struct(*[docs[c] for c in rest]).alias("_doc"), docs[id_col].alias("_i"), docs[text_col].alias("_t"))
    text = F.coalesce(F.col("_t").cast("string"), F.lit(""))
    joined = held.join(gone, F.col("_i").eqNullSafe(F.col("_gid")) & (F.xxhash64(text) == F.col("_gkey")), "left")
    joined = line_chunks(joined, "_i", "_t", window, divisor)
    # documents without removals keep their text as it is
    kept = F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(
        # set difference: linear, however many chunks go
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size("_chunks")), "_gone"), lambda i: F.element_at("_chunks", i)), "\n"))
    lines = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    removed = F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate("_gone", F.lit(0).cast("long"), lambda a, k: a + F.element_at("_sizes", k)))
    chunks = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    done = joined.select("_doc", kept.alias("_kept"), *[x.alias(f"_c{i}") for i, x in enumerate((lines, removed, chunks))])
    own = [F.col("_kept").alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in counts]
    return done.select(*own, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(counts)])
