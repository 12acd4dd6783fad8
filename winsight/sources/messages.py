"""Message sources and encoders.

``read_messages`` gives the streaming DataFrame of a topic
(``key, value, topic, partition, offset, timestamp``).  The message
connector jar is optional; file streams (json/csv/parquet/text) go through
the same function so suites run anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import pack_row


def read_messages(spark: SparkSession, fmt: str = "kafka", options: dict | None = None, *,
                  path: str | None = None, schema: T.StructType | None = None,
                  starting_offsets: str = "earliest", streaming: bool = True) -> DataFrame:
    """Subscribe to a topic (``fmt='kafka'``) or watch a folder of files."""
    opts = dict(options or {})
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        opts.setdefault("startingOffsets", starting_offsets)
        return reader.format("kafka").options(**opts).load()
    if schema is None and fmt != "text":
        raise ValueError("file streams need an explicit schema")
    r = reader.format(fmt).options(**opts)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def decode_json(df: DataFrame, schema: T.StructType, value_col: str = "value", keep=()) -> DataFrame:
    """Value bytes/text -> declared struct -> flat columns.

    Malformed JSON yields a row of nulls; a field of the wrong type is null.
    """
    parsed = F.from_json(F.col(value_col).cast("string"), schema, {"mode": "PERMISSIVE"})
    return df.select(*keep, parsed.alias("_j")).select(*keep, "_j.*")


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """K2: constant key + the whole row as JSON, the shape a topic sink takes."""
    return df.select(F.lit(key).alias("key"), F.to_json(pack_row(df)).alias("value"))


def write_messages(df: DataFrame, topic: str, options: dict) -> None:
    """K2 sink for batch frames (streaming frames use ``writeStream.format('kafka')``)."""
    df.write.format("kafka").options(**options).option("topic", topic).save()


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet file(s) of one table out of a shared folder.

    The file source wants a folder, so the folder is watched with a glob
    filter selecting the table's file(s).
    """
    if schema is None:
        schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)
