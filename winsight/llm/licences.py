"""Licence scan: TF-IDF cosine to templates, then inheritance along paths.

Every sentence of every text is compared with the notices below by the cosine
of sparse TF-IDF vectors.  Document frequencies of the templates' words cover
all texts; any other word weighs like one no document has.  A file that is
little else than a notice speaks for its directory; a file without a notice of
its own takes the one of the nearest directory above it, by equality joins of
each directory's ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winsight.session import materialise

# Licence notices by SPDX id.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
THRESHOLD = 0.8
#: Share of a text's words in notices from which it counts as a licence file.
FILE_SHARE = 0.25

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_SENTENCE = re.compile(r"\n|(?<=[.!?;])\s+")
#: Sentences longer than this in words (none of the notices is near it) are read in overlapping windows.
_WINDOW = 64


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> Iterator[list[str]]:
    """The sentences of a text as words; very long ones in half-overlapping windows."""
    for part in _SENTENCE.split(text):
        found = words(part)
        for i in range(0, max(1, len(found) - _WINDOW // 2), _WINDOW // 2):
            if found:
                yield found[i:i + _WINDOW]


class Matcher:
    """Cosine of a sentence to the nearest template."""

    def __init__(self, frequency: dict[str, int], documents: int, templates: dict = TEMPLATES):
        self.other = 1.0 + math.log(1 + documents)
        vectors = [(name, Counter(words(t))) for name, ts in sorted(templates.items()) for t in ts]
        vocabulary = {w for _, c in vectors for w in c}
        self.idf = {w: 1.0 + math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in vocabulary}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in vectors]
        for i, (_, c) in enumerate(vectors):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.postings.setdefault(w, []).append((i, n * self.idf[w] / norm))

    def nearest(self, sentence: list[str], least: float) -> tuple[str | None, float]:
        """The licence and cosine of the nearest template, if ``least`` is reached."""
        idf, counts = self.idf, Counter(sentence)
        shared = inside = 0.0
        for w, n in counts.items():
            weight = idf.get(w)
            if weight is None:
                shared += (n * self.other) ** 2
            else:
                inside += (n * weight) ** 2
        # the cosine cannot exceed the templates' share of the sentence's length
        if inside < (least * least - 1e-12) * (shared + inside) or not inside:
            return None, 0.0
        dots: dict[int, float] = {}
        for w, n in counts.items():
            for i, v in self.postings.get(w, ()):
                dots[i] = dots.get(i, 0.0) + n * idf[w] * v
        best = min(dots, key=lambda i: (-dots[i], self.names[i]))
        cosine = dots[best] / math.sqrt(shared + inside)
        return (self.names[best], cosine) if cosine >= least else (None, 0.0)

    def scan(self, text: str | None, least: float = THRESHOLD) -> tuple[str | None, float, float]:
        """The best notice of a text, its cosine, and the share of the words in notices."""
        best, score, inside, total = None, 0.0, 0, 0
        for s in sentences(text or ""):
            total += len(s)
            name, cosine = self.nearest(s, least)
            if name is not None:
                inside += len(s)
                if (cosine, best or "") > (score, best or "") or best is None:
                    best, score = name, cosine
        return best, score, inside / total if total else 0.0


def frequencies(docs: DataFrame, text_col: str = "text", templates: dict = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all texts each word of the templates occurs, and how many texts there are."""
    vocabulary = {w for ts in templates.values() for t in ts for w in words(t)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text"):
                seen.update(vocabulary.intersection(words(t.as_py() or "")))
            seen[""] = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    found = {r["word"]: r["n"] for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per template word
    return found, found.pop("", 0)


def scan_licences(docs: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, file_share: float = FILE_SHARE, templates: dict = TEMPLATES) -> DataFrame:
    """One row per file: ``id_col, path, licence, via, score``.

    ``via`` is ``file`` (a licence file), ``header`` (a notice among other
    text), ``inherited`` or ``none``.  Two licence files in one directory: the
    higher score, then the smaller path decides.  Defined results: a null
    text has no notice; a null path is the root directory; equal scores go to
    the first licence in order; repeated rows each get a row; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Matcher(*frequencies(docs, text_col, templates), templates))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
                       F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.scan(t.as_py(), threshold) for t in b.column("text")]
            name, score, share = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(share, pa.float64())], ["id", "path", "licence", "score", "share"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, path string, licence string, score double, share double")
    # the directory: everything before the last slash
    found = materialise(found.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "licence-files")
    stated = (found.where(F.col("licence").isNotNull() & (F.col("share") >= file_share))
              .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("rank"), "path", "licence", "score")).alias("s"))
              .select(F.col("dir").alias("above"), F.col("s.licence").alias("dir_licence"), F.col("s.score").alias("dir_score")))
    # ancestors of each directory, itself and the root included
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
                        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = found.select("dir").distinct().select("dir", F.explode_outer(above).alias("a")).select("dir", "a.depth", "a.above")
    nearest = (dirs.join(stated, "above").groupBy("dir").agg(F.max(F.struct("depth", "dir_licence", "dir_score")).alias("n"))
               .select("dir", F.col("n.dir_licence").alias("dir_licence"), F.col("n.dir_score").alias("dir_score")))
    out = found.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(own & (F.col("share") >= file_share), "file").when(own, "header").when(F.col("dir_licence").isNotNull(), "inherited")
        .otherwise("none").alias("via"), F.when(own, F.col("score")).otherwise(F.coalesce("dir_score", F.lit(0.0))).alias("score"))
