"""Windowed quality job driven by settings (environment variables).

    WINDOW_TYPE=sliding WINDOW_DURATION="10 minutes" SLIDE_DURATION="1 minutes" \
    RECORDS=comments SOURCE_FORMAT=kafka KAFKA_BOOTSTRAP_SERVERS=host:9092 \
    INPUT_TOPIC=data_input OUTPUT_PATH=/shared/results spark-submit jobs/quality_job.py

One streaming query: source -> decode -> one grouped aggregation with every
check -> result records (one per tag and window, emitted when the window
closes) -> file sink (or a topic when OUTPUT_TOPIC is set).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from winsight import WindowSpec, window_result  # noqa: E402
from winsight.checks import comment_checks, prepare_comments, prepare_products, product_checks  # noqa: E402
from winsight.functions.durations import duration_ms  # noqa: E402
from winsight.session import checkpoint_dir  # noqa: E402
from winsight.streaming.sessions import SessionMeasures  # noqa: E402
from winsight.sources.messages import read_messages, to_messages, write_messages  # noqa: E402
from winsight.sources.sinks import batch_files, stream_to_files  # noqa: E402


# The names of the settings and their defaults.
def build(spark: SparkSession, env=os.environ):
    spec = WindowSpec.parse(env.get("WINDOW_TYPE", "tumbling"), env.get("WINDOW_DURATION", "10 seconds"),
                            env.get("SLIDE_DURATION", "5 seconds"), env.get("GAP_DURATION", "5 seconds"))
    fmt = env.get("SOURCE_FORMAT", "kafka")
    options = {"kafka.bootstrap.servers": env.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"),
               "subscribe": env.get("INPUT_TOPIC", "data_input")} if fmt == "kafka" else {}
    # file sources carry the message value as one line of JSON text
    raw = read_messages(spark, fmt if fmt == "kafka" else "text", options, path=env.get("SOURCE_PATH"),
                        starting_offsets=env.get("STARTING_OFFSETS", "earliest"))
    if env.get("RECORDS", "comments") == "comments":
        records, suite, time_col, tags = prepare_comments(raw), comment_checks(), "created_utc", ["blast_id"]
    else:
        records, suite, time_col, tags = prepare_products(raw), product_checks(), "eventTime", []
    constants = {"numCores": env.get("SPARK_NUM_CORES", "*")}
    watermark = env.get("WATERMARK", "0 seconds")
    if spec.kind == "session":
        # sessions with a uniqueness check stream through carried bucket partials
        return SessionMeasures(spark, spec, time_col, suite.measures(), tags, delay_ms=delay_ms(watermark),
                               post=lambda out: window_result(suite.finish(out), spec, constants, keep=tags),
                               sink=session_sink(env), checkpoint=checkpoint(env)), records
    result = suite.evaluate(records, spec, time_col, tags, watermark=watermark)
    return window_result(result, spec, constants, keep=tags)


def delay_ms(text: str) -> int:
    """A watermark delay; unlike a window's length it may be zero."""
    return 0 if re.fullmatch(r"\s*0+(\.0+)?\s*[a-z]+\s*", text, re.IGNORECASE) else duration_ms(text)


def checkpoint(env) -> str:
    """A job that runs for long must find its progress again after a restart."""
    if not env.get("CHECKPOINT"):
        raise ValueError("CHECKPOINT is not set; name a shared folder that stays the same over restarts")
    return env["CHECKPOINT"]


def output_path(env) -> str:
    if not env.get("OUTPUT_PATH"):
        raise ValueError("set OUTPUT_PATH (files) or OUTPUT_TOPIC (messages)")
    return env["OUTPUT_PATH"]


def messages_of(results, env):
    return to_messages(results, env.get("RESULT_KEY", "winsight"))


def session_sink(env):
    """The per-batch sink of closed sessions: the topic, or a folder per batch."""
    if env.get("OUTPUT_TOPIC"):
        options = {"kafka.bootstrap.servers": env.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092")}
        return lambda batch, batch_id: write_messages(messages_of(batch, env), env["OUTPUT_TOPIC"], options)
    return batch_files(output_path(env), env.get("OUTPUT_FORMAT", "csv"))


def start(spark: SparkSession, env=os.environ, trigger: dict | None = None):
    """Build the job and start its query."""
    out = build(spark, env)
    if isinstance(out, tuple):  # session windows: a foreachBatch processor and its input stream
        proc, records = out
        return proc.start(records, trigger)
    if env.get("OUTPUT_TOPIC"):
        w = (messages_of(out, env).writeStream.format("kafka")
             .option("kafka.bootstrap.servers", env.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"))
             .option("topic", env["OUTPUT_TOPIC"]).option("checkpointLocation", checkpoint(env)))
        return w.trigger(**(trigger or {"processingTime": "1 second"})).start()
    return stream_to_files(out, output_path(env), checkpoint(env), env.get("OUTPUT_FORMAT", "csv"), trigger=trigger)


def main() -> None:
    spark = SparkSession.builder.appName("windowed-quality").getOrCreate()
    checkpoint_dir(spark)
    start(spark).awaitTermination()


if __name__ == "__main__":
    main()
