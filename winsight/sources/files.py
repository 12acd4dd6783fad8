"""File readers for records, timings, values and run reports.

All readers take an explicit schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

TIMING_LAYOUTS = {
    # headered file with a ``timestamp`` column
    "headered": dict(header=True, names=None, rename=None),
    # headered file whose ``time`` column is the timestamp
    "headered_time": dict(header=True, names=None, rename="time"),
    # headerless ``value1,timestamp``
    "two": dict(header=False, names=("value1", "timestamp"), rename=None),
    # headerless ``value1,value2,timestamp``
    "three": dict(header=False, names=("value1", "value2", "timestamp"), rename=None),
}


def read_records_csv(spark: SparkSession, path: str, schema: T.StructType, fill_empty_strings: bool = True) -> DataFrame:
    """S3: headered UTF-8 CSV with quoted multi-line cells.

    Cells that span lines cannot be split inside a file, so one file is one
    task: keep many files of moderate size rather than one large one.

    Spark reads empty cells as null; a dict-row CSV reader keeps ``''``, so
    string columns are filled back to ``''`` (completeness depends on it).
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .option("timestampNTZFormat", NTZ_FORMAT).csv(path))
    if fill_empty_strings:
        strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        if strings:
            df = df.na.fill("", subset=strings)
    return df


def read_timings_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Timing CSV -> ``file, timestamp`` (long) for one of :data:`TIMING_LAYOUTS`."""
    if layout not in TIMING_LAYOUTS:
        raise ValueError(f"unknown timing layout {layout!r}; choose from {sorted(TIMING_LAYOUTS)}")
    spec = TIMING_LAYOUTS[layout]
    if spec["header"]:
        # a header decides where the column is, file by file: the lines are read as
        # text, and each file's first line is joined back to its other lines
        return _headered_timings(spark, path, spec["rename"] or "timestamp")
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in spec["names"]])
        df = spark.read.schema(schema).option("header", False).csv(path)
        ts = F.col("timestamp")
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.trim(ts).try_cast("double").cast("long").alias("timestamp"))


def _headered_timings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``file, timestamp`` of headered files whose columns may be in any order.

    One row per file (its header's place of ``name``) is joined to the file's
    lines.  A file without the column fails the read.
    """
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
             .where("value <> ''"))
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1")))
    lines = lines.select("file", cells.alias("cells"))
    head = lines.where(F.array_contains("cells", name)).select(
        F.col("file").alias("_file"), (F.array_position("cells", name)).cast("int").alias("_at")).groupBy("_file").agg(F.max("_at").alias("_at"))
    at = F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit(f"no column {name!r} in "), "file")).cast("int")).otherwise(F.col("_at"))
    joined = lines.where(~F.array_contains("cells", name)).join(head, F.col("file") == F.col("_file"), "left")
    return joined.select("file", F.get("cells", at - 1).try_cast("double").cast("long").alias("timestamp"))


def layout_for(run_name: str, rules: dict[str, str], default: str = "three") -> str:
    """Pick a timing layout by a substring of the run name (first match wins)."""
    for needle, layout in rules.items():
        if needle in run_name:
            return layout
    return default


def parent_dir(file_col: str = "file"):
    """Name of the folder a file sits in (a run is a folder of timing files)."""
    return F.regexp_extract(F.col(file_col), r"([^/]+)/[^/]+$", 1)


def read_values_text(spark: SparkSession, path: str) -> DataFrame:
    """One number per line -> ``file, value`` (double); blank lines dropped."""
    df = spark.read.text(path)
    v = F.trim(F.col("value"))
    return df.where(v != "").select(F.col("_metadata.file_path").alias("file"), v.try_cast("double").alias("value"))


def read_run_start(spark: SparkSession, path: str) -> DataFrame:
    """JSON run report(s) -> ``file, start`` (long)."""
    schema = T.StructType([T.StructField("start", T.StringType())])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("start").try_cast("double").cast("long").alias("start"))
