"""Ready-made record schemas, suites and monitors for the two experiment jobs.

* products: generated product records, event time ``eventTime`` in epoch ms;
* comments: replayed comment records, event time ``created_utc`` in epoch s,
  tagged with the replay batch (``blast_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.casts import RECORD_INT_FIELDS, rename_if_present, safe_cast
from .functions.time import epoch_ms, epoch_s
from .operators import measures as M
from .operators.suite import Suite
from .sources.messages import decode_json

# Field names and types of the product records.
PRODUCT_SCHEMA = T.StructType([
    T.StructField("id_", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("numViews", T.LongType()),
    T.StructField("eventTime", T.LongType()),
])

# Field names and types of the comment records, plus the two
# replay-batch tags.
COMMENT_SCHEMA = T.StructType([
    T.StructField("created_utc", T.LongType()),
    T.StructField("ups", T.IntegerType()),
    T.StructField("subreddit_id", T.StringType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("score_hidden", T.IntegerType()),
    T.StructField("author_flair_css_class", T.StringType()),
    T.StructField("author_flair_text", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("id_", T.StringType()),
    T.StructField("removal_reason", T.StringType()),
    T.StructField("gilded", T.IntegerType()),
    T.StructField("downs", T.IntegerType()),
    T.StructField("archived", T.IntegerType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("retrieved_on", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("edited", T.IntegerType()),
    T.StructField("controversiality", T.IntegerType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("blast_id", T.StringType()),
    T.StructField("blast_start_time", T.StringType()),
])

# Accepted product priorities.
PRIORITIES = ("high", "medium", "low")


def product_checks() -> Suite:
    return (Suite("Product checks")
            .is_complete("id_").is_unique("id_")
            .has_max("numViews", lambda v: v < 90)
            .is_contained_in("priority", PRIORITIES)
            .is_non_negative("numViews"))


def comment_checks() -> Suite:
    return (Suite("Comment checks")
            .is_complete("id_").is_unique("id_")
            .has_min("downs", lambda v: v >= 0)
            .has_mean("controversiality", lambda v: v < 0.05)
            .has_completeness("author", lambda v: v > 0.9))


def product_measures() -> dict[str, M.Measure]:
    return {"count": M.count("id_"), "is_id_unique": M.fraction_of_unique("id_"),
            "max_views": M.max("numViews"),
            "priority_conformance": M.fraction_of_set_conformance("priority", PRIORITIES),
            "min_views": M.min("numViews")}


def comment_measures() -> dict[str, M.Measure]:
    return {"count": M.count("id_"), "is_id_unique": M.fraction_of_unique("id_"),
            "non_negative_downs": M.min("downs"), "mean_controversiality": M.mean("controversiality"),
            "author_completeness": M.count("author")}


def prepare_products(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Message values -> product rows with ``eventTime`` as a timestamp."""
    df = decode_json(messages, PRODUCT_SCHEMA, value_col)
    return df.withColumn("eventTime", epoch_ms("eventTime"))


def prepare_comments(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Message values -> comment rows with ``created_utc``/``retrieved_on`` as timestamps."""
    df = decode_json(messages, COMMENT_SCHEMA, value_col)
    return df.withColumns({"created_utc": epoch_s("created_utc"), "retrieved_on": epoch_s("retrieved_on")})


def clean_comment_records(records: DataFrame) -> DataFrame:
    """Replay preprocessing of comment rows read from CSV (S3 -> P4, P5): the
    numeric fields become whole numbers (unparseable -> null) and ``id`` is
    renamed ``id_``."""
    return rename_if_present(safe_cast(records, {c: "bigint" for c in RECORD_INT_FIELDS}), "id", "id_")
