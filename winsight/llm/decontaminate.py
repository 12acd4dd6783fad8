"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

One pass over the training documents turns every window of words into a
64-bit hash and probes the set of benchmark window hashes; only windows that
hit leave the scan.  Hits are verified against the window's words before they
count.  The hash set is broadcast while the benchmark's distinct windows stay
under ``broadcast_windows`` (8 bytes each); beyond that the same join shuffles
the hashes and places of the windows, and the words of hits are fetched after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winsight.llm.words import alnum_words, unlike
from winsight.session import materialise

#: Largest number of distinct benchmark windows whose hashes are broadcast (about 64 MB as a hash table).
BROADCAST_WINDOWS = 2_000_000


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``_item, _len, _window, _h``: each item's windows of ``n`` words, or all its words when it has fewer."""
    items = benchmark.select(F.col(id_col).alias("_item"), alnum_words(F.col(text_col).cast("string")).alias("_w"))
    items = items.where(F.size("_w") > 0).withColumn("_len", F.least(F.size("_w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1)
    windows = items.select("_item", "_len", F.explode(F.transform(starts, lambda i: F.slice("_w", i, F.col("_len")))).alias("_ws"))
    return windows.select("_item", "_len", F.concat_ws(" ", "_ws").alias("_window"), F.xxhash64("_ws").alias("_h")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated, hits, _key``.

    ``hits`` lists the 0-based starts and lengths of the verified windows, and
    ``_key`` (hash of the text) tells rows of the same id apart.

    Defined results: a null or wordless text has no words and no hits; a
    wordless item has no window; an empty benchmark contaminates nothing;
    repeated rows each get their own equal result; items that share an id
    count once; null item ids never appear in a list of items.
    """
    windows = materialise(benchmark_windows(benchmark, n, item_col, item_text_col), "bench-windows")
    lens = sorted(r["_len"] for r in windows.select("_len").distinct().collect())  # at most n values
    hashes = windows.select(F.col("_h").alias("_bh")).distinct()
    small = hashes.count() <= broadcast_windows

    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"),
                        alnum_words(F.col(text_col).cast("string")).alias("_w"))
    # windows of every length in use, one after the other; the first entry stands for the document itself
    size = F.size("_w")

    def hashed(k: int):
        starts = F.when(size >= k, F.sequence(F.lit(1), size - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, F.lit(k))))

    grams = [hashed(k) for k in lens]
    grams = words.withColumn("_g", F.concat(F.array(F.lit(None).cast("long")), *grams))
    # outer: never empty, and a plain explode would add a filter that works out the windows a second time
    each = F.posexplode_outer("_g").alias("_at", "_h")
    if small:
        rows = grams.select("_id", "_key", "_w", each)
        rows = rows.join(F.broadcast(hashes), F.col("_h") == F.col("_bh"), "left").where((F.col("_at") == 0) | F.col("_bh").isNotNull())
    else:  # a document's words stay out of the join; the documents themselves too
        hits = grams.select("_id", "_key", each).where(F.col("_h").isNotNull()).join(hashes, F.col("_h") == F.col("_bh"), "left_semi")
        hits = hits.distinct().select(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey"), "_at", "_h")
        rows = words.join(hits, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_key") == F.col("_hkey"))).select("_id", "_key", "_w", "_at", "_h")
        rows = rows.unionByName(words.select("_id", "_key", "_w", F.lit(0).alias("_at"), F.lit(None).cast("long").alias("_h")))
    # place in the concatenation -> window length and start
    start, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in lens:
        count = F.greatest(F.lit(0), F.size("_w") - (k - 1))
        here = (F.col("_at") >= before) & (F.col("_at") < before + count)
        start, length = F.when(here, F.col("_at") - before).otherwise(start), F.when(here, F.lit(k)).otherwise(length)
        before = before + count
    rows = rows.select("_id", "_key", F.size("_w").alias("_n"), start.alias("_s"), length.alias("_len"), "_h",
                       F.when(F.col("_at") > 0, F.concat_ws(" ", F.slice("_w", start + 1, length))).alias("_window"))
    rows = materialise(rows, "bench-hits")  # a row per document and a row per hit

    doc = [F.col("_id"), F.col("_key")]
    base = rows.where(F.col("_s").isNull()).groupBy(*doc).agg(F.first("_n").alias("n_words"), F.count("*").alias("_rows"))
    found = (rows.where(F.col("_s").isNotNull())
             .join(windows.select("_h", "_window").distinct(), ["_h", "_window"], "left_semi")
             .select("_id", "_key", "_s", "_len", "_window"))
    spans = found.groupBy(*doc).agg(F.array_sort(F.collect_set(F.struct("_s", "_len"))).alias("hits"))
    items = (found.select("_id", "_key", "_window").distinct()
             .join(windows.select("_item", "_window").where(F.col("_item").isNotNull()), "_window")
             .select("_id", "_key", F.col("_item").cast("string").alias("_item")).distinct()
             .groupBy(*doc).agg(F.array_sort(F.collect_list("_item")).alias("_items")))
    out = base
    for part in (spans, items):
        part = part.withColumnRenamed("_id", "_pid").withColumnRenamed("_key", "_pkey")
        out = out.join(part, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_key") == F.col("_pkey")), "left").drop("_pid", "_pkey")
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["_s"], h["_s"] + h["_len"] - 1)))))
    out = out.select(
        F.col("_id").alias(id_col), "_key", "_rows", F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("hits").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", F.array().cast("array<string>"))), 256).alias("items_sha256"), "hits")
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_", "_rows")  # repeated rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contamination, same columns.

    ``mode='documents'`` removes every document with a hit; ``mode='spans'``
    keeps it without the hit words (the characters between words stay).
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    name = {n: unlike(docs.columns, n) for n in ("_hit_id", "_hit_key", "_hits")}
    hit = (scan(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
           .select(F.col(id_col).alias(name["_hit_id"]), F.col("_key").alias(name["_hit_key"]), F.col("hits").alias(name["_hits"]))
           .dropDuplicates([name["_hit_id"], name["_hit_key"]]))
    on = docs[id_col].eqNullSafe(hit[name["_hit_id"]]) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(hit[name["_hit_key"]])
    if mode == "documents":
        return docs.join(hit, on, "left_anti")
    joined = docs.join(hit, on, "left")
    text, hits = docs[text_col].cast("string"), hit[name["_hits"]]
    kept = F.when(hits.isNull(), text).otherwise(_without(text, hits))
    return joined.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _without(text, hits):
    """The text with the hit words left out."""
    # each piece: what stands before a word, and the word; A-Z count as word characters here
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
    gone = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["_s"], h["_s"] + h["_len"] - 1))))
    pieces = F.regexp_extract_all(text, F.lit(f"({piece})"), F.lit(1))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)

    def joined(row):
        # set operations on the places: linear, however many words go
        places = F.sequence(F.lit(0), F.greatest(F.size(row["pieces"]) - 1, F.lit(0)))
        whole = F.transform(F.array_except(places, row["gone"]), lambda i: F.struct(i.alias("i"), F.get(row["pieces"], i).alias("t")))
        cut = F.transform(F.array_intersect(places, row["gone"]),
                          lambda i: F.struct(i.alias("i"), F.regexp_replace(F.get(row["pieces"], i), word, "").alias("t")))
        return F.array_join(F.transform(F.array_sort(F.concat(whole, cut)), lambda p: p["t"]), "")

    # a one-row array, so that the pieces are found once and not once per place
    rows = F.transform(F.array(F.struct(pieces.alias("pieces"), gone.alias("gone"))), joined)
    return F.concat(F.coalesce(F.element_at(rows, 1), F.lit("")), tail)
