"""Run summaries from a result topic (the consumer's role, A1-A4), driven by settings.

    OUTPUT_TOPIC=data_output KAFKA_BOOTSTRAP_SERVERS=host:9092 WINDOW_TYPE=tumbling \
    WINDOW_DURATION="1 minutes" SUMMARY_PATH=/shared/summary spark-submit jobs/summary_job.py

Result messages keyed by a tool name are totalled per batch; a marker message
(key ``BLAST_KEY``) closes the batch and yields one summary row per active tool.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from winsight.functions.durations import WindowSpec  # noqa: E402
from winsight.session import checkpoint_dir  # noqa: E402
from winsight.sources.messages import read_messages  # noqa: E402
from winsight.streaming.summary import SummaryStream  # noqa: E402


def build(spark: SparkSession, env=os.environ):
    spec = WindowSpec.parse(env.get("WINDOW_TYPE", "tumbling"), env.get("WINDOW_DURATION", "10 seconds"),
                            env.get("SLIDE_DURATION", "10 seconds"), env.get("GAP_DURATION", "5 seconds"))
    constants = {"window_setting": spec.label(), "number_of_cores": env.get("SPARK_NUM_CORES", "20"),
                 "number_of_threads": env.get("NUM_THREADS", "1"), "memory_limit": env.get("MEMORY_LIMIT", "8G"),
                 "experiment_type": env.get("EXPERIMENT_TYPE", "kafka")}
    tools = [env.get("MONITOR_KEY", "monitor"), env.get("CHECKS_KEY", "checks")]
    if not env.get("SUMMARY_PATH"):
        raise ValueError("SUMMARY_PATH is not set; name a shared folder that stays the same over restarts")
    summary = SummaryStream(spark, env.get("BLAST_KEY", "blast"), tools, tools[0], constants, base=env["SUMMARY_PATH"])
    fmt = env.get("SOURCE_FORMAT", "kafka")
    options = {"kafka.bootstrap.servers": env.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"),
               "subscribe": env.get("OUTPUT_TOPIC", "output_topic")} if fmt == "kafka" else {}
    schema = None if fmt == "kafka" else summary_message_schema()
    messages = read_messages(spark, fmt, options, path=env.get("SOURCE_PATH"), schema=schema)
    return summary, messages


def summary_message_schema():
    """Result messages kept as files: the topic's columns."""
    from pyspark.sql import types as T
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
                         T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
                         T.StructField("timestamp", T.TimestampType())])


def main() -> None:
    spark = SparkSession.builder.appName("run-summaries").getOrCreate()
    checkpoint_dir(spark)
    summary, messages = build(spark)
    summary.start(messages).awaitTermination()


if __name__ == "__main__":
    main()
