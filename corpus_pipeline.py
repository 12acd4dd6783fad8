"""From raw documents to a training mix: five stages, each one operator of ``winsight.llm``.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``.  Its result
is written as Parquet under the shared folder and read again as the next
stage's ``docs``, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winsight.llm import langid
from winsight.llm.decontaminate import decontaminate
from winsight.llm.lines import dedup_lines
from winsight.llm.mixing import mix_documents
from winsight.llm.simhash import keep_one
from winsight.llm.words import unlike
from winsight.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with confidence; learned from the documents outside the held-out fold."""
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.accept(docs, model, least=0.5)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that stand in an earlier document; documents of which nothing is left go."""
    counts = tuple(unlike(docs.columns, n) for n in ("_n_lines", "_lines_removed", "_chunks_removed"))
    out = dedup_lines(docs, counts=counts)
    removed = out[counts[2]]
    out = out.where((removed == 0) | out["text"].rlike(r"\S"))
    length = F.when(removed > 0, F.length("text").cast("long")).otherwise(out["n_chars"])
    return out.withColumn("n_chars", length).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_one(docs, shingle=3, max_bits=3)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with the number of the copy."""
    return mix_documents(docs)


STAGES = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each),
    ("decontaminate", unseen_tests),
    ("mix", weighted_mix),
]

#: Models, fingerprints and rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
