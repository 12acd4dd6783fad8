"""Event-time conversions (built-in expressions only, no UDFs).

Spark keeps two timestamp types.  Parquet written without a zone reads as
``timestamp_ntz``; message sources give ``timestamp`` (session zone).  The
helpers below do exact integer arithmetic on microseconds and convert back
to the *same* type, so window bounds never shift with the session zone.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime.datetime(1970, 1, 1)

# Strftime directives and the Spark datetime pattern letters
# they stand for (used to accept the monitor's Python-style time formats).
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%z": "Z", "%%": "%",
}


def epoch_ntz() -> Column:
    # from text: a datetime literal would pass through the session time zone
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_micros(c: Column | str, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 for either timestamp type.

    Given a column *name*, the expression is built as one SQL snippet (one
    JVM round trip instead of about twenty).
    """
    if isinstance(c, str):
        q = "`" + c.replace("`", "``") + "`"
        if isinstance(dtype, T.TimestampNTZType):
            return F.expr(f"(datediff(to_date({q}), DATE'1970-01-01') * 86400000000L + hour({q}) * 3600000000L"
                          f" + minute({q}) * 60000000L + CAST(extract(SECOND FROM {q}) * 1000000 AS BIGINT))")
        return F.expr(f"unix_micros({q})")
    if isinstance(dtype, T.TimestampNTZType):
        # field arithmetic: exact and independent of the session time zone
        days = F.date_diff(F.to_date(c), F.lit(_EPOCH.date()))
        return (days.cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000
                + F.minute(c).cast("long") * 60_000_000
                + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"))
    return F.unix_micros(c)


def from_micros(us: Column, dtype: T.DataType) -> Column:
    """Inverse of :func:`to_micros`, returning ``dtype``."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", us, epoch_ntz())
    return F.timestamp_micros(us)


def floor_div(a: Column, b: int) -> Column:
    """Exact floor division by a positive integer (also for negative ``a``)."""
    b = F.lit(int(b)).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def epoch_ms(c: Column | str) -> Column:
    """Epoch milliseconds (long) -> timestamp; null stays null."""
    return F.timestamp_millis(F.col(c) if isinstance(c, str) else c)


def epoch_s(c: Column | str) -> Column:
    """Epoch seconds (long) -> timestamp."""
    return F.timestamp_seconds(F.col(c) if isinstance(c, str) else c)


def spark_pattern(fmt: str) -> str:
    """Accept either a Spark datetime pattern or a strftime format."""
    if "%" not in fmt:
        return fmt
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in STRFTIME_TO_SPARK:
            out.append(STRFTIME_TO_SPARK[tok])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def parse_ts(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """Text -> timestamp with a pattern; unparseable text -> null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col, F.lit(spark_pattern(fmt)))


def event_time(df: DataFrame, time_col: str, *, streaming: bool | None = None) -> DataFrame:
    """Make ``time_col`` usable as event time.

    Numbers are not guessed at; callers convert epoch columns with
    :func:`epoch_ms`/:func:`epoch_s` first.  Streaming needs the session-zone
    ``timestamp`` type for watermarks, so ``timestamp_ntz`` is cast there.
    """
    streaming = df.isStreaming if streaming is None else streaming
    dtype = df.schema[time_col].dataType
    if isinstance(dtype, T.StringType):
        return df.withColumn(time_col, parse_ts(time_col))
    if streaming and isinstance(dtype, T.TimestampNTZType):
        # same epoch micros, so windows align exactly as in batch, whatever the zone
        return df.withColumn(time_col, F.timestamp_micros(to_micros(time_col, dtype)))
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"time column {time_col!r} must be a timestamp or text, got {dtype.simpleString()}")
    return df
