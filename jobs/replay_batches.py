"""Prepare a record file for batched replay: the data work of the replay
producer, without its pacing (P4, P5, B1, B2, K2).

    RECORDS_CSV=/shared/comments.csv MESSAGES_PER_WINDOW="100,200,300" \
    OUT_PATH=/shared/replay spark-submit jobs/replay_batches.py

Writes ``records`` (cleaned rows tagged with ``blast_id``) and ``markers``
(one ``blast`` message per full batch) as JSON message folders.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from winsight.checks import clean_comment_records  # noqa: E402
from winsight.operators.batches import assign_batches, batch_markers, parse_sizes  # noqa: E402
from winsight.session import checkpoint_dir, materialise  # noqa: E402
from winsight.sources.files import read_records_csv  # noqa: E402
from winsight.sources.messages import to_messages  # noqa: E402


def build(spark: SparkSession, env=os.environ) -> tuple[DataFrame, DataFrame]:
    path = env["RECORDS_CSV"]
    header = spark.read.option("header", True).csv(path).columns  # names only; every cell is text
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # the position is written once: it is not the same on every evaluation
    rows = materialise(read_records_csv(spark, path, schema).withColumn("_pos", F.monotonically_increasing_id()), "replay")
    sizes = parse_sizes(env.get("MESSAGES_PER_WINDOW", "100,200,300"))
    tagged = assign_batches(clean_comment_records(rows), "_pos", sizes).withColumnRenamed("batch_id", "blast_id")
    records = to_messages(tagged.drop("_pos", "batch_size"), env.get("RECORD_KEY", "record"))
    markers = to_messages(batch_markers(tagged.withColumnRenamed("blast_id", "batch_id"))
                          .select(F.col("batch_id").alias("blast_id"), F.col("batch_size").alias("blast_size")),
                          env.get("BLAST_KEY", "blast"))
    return records, markers


def main() -> None:
    spark = SparkSession.builder.appName("replay-batches").getOrCreate()
    checkpoint_dir(spark)
    records, markers = build(spark)
    out = os.environ["OUT_PATH"].rstrip("/")
    records.write.mode("overwrite").json(f"{out}/records")
    markers.write.mode("overwrite").json(f"{out}/markers")


if __name__ == "__main__":
    main()
