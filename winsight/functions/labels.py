"""Message routing and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def route_by_key(key, known, default: str) -> Column:
    """Message key (binary or text) -> source name.

    Null, undecodable or unknown keys go to ``default``.
    """
    k = _c(key)
    text = k.cast("string")
    return F.when(text.isin(list(known)), text).otherwise(F.lit(default))


def arrival_ms(timestamp="timestamp") -> Column:
    """Broker timestamp of a message as epoch milliseconds."""
    return F.unix_millis(_c(timestamp))


def window_label(kind, duration, slide, gap) -> Column:
    """P10: ``tumbling_D``, ``sliding_D_S``, ``session_D_G``; other kinds -> null.

    Kind matching is case-insensitive; the label uses the lower-case kind and
    the texts as given (null texts print as ``None``, like Python f-strings).
    """
    k = F.lower(_c(kind))
    def txt(c):
        return F.coalesce(_c(c).cast("string"), F.lit("None"))
    return (F.when(k == "tumbling", F.concat_ws("_", k, txt(duration)))
             .when(k == "sliding", F.concat_ws("_", k, txt(duration), txt(slide)))
             .when(k == "session", F.concat_ws("_", k, txt(duration), txt(gap))))
