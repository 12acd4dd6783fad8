"""Projections and casts on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numeric fields of the comment records that arrive as text and
# are cast to whole numbers before checking.
RECORD_INT_FIELDS = ("created_utc", "score_hidden", "gilded", "ups", "downs", "archived", "score",
                     "retrieved_on", "edited", "controversiality")


def safe_cast(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """``try_cast`` each listed column that exists; unparseable -> null.

    Text is trimmed first, so ``' 7 '`` -> 7 while ``''``, ``'x'`` and
    ``'1.0'`` -> null for integer targets.  Typed columns are cast as they
    are: double ``5.0`` -> 5 and ``true`` -> 1.
    """
    present = {c: t for c, t in casts.items() if c in df.columns}

    def cast(c: str, t: str) -> Column:
        text = isinstance(df.schema[c].dataType, (T.StringType, T.VarcharType, T.CharType))
        return (F.trim(F.col(c)) if text else F.col(c)).try_cast(t)

    return df.withColumns({c: cast(c, t) for c, t in present.items()}) if present else df


def rename_if_present(df: DataFrame, old: str, new: str) -> DataFrame:
    """P5: rename only when the column exists."""
    return df.withColumnRenamed(old, new)


def tag_constants(df: DataFrame, constants: dict) -> DataFrame:
    """Stamp run settings on each record."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def pack_row(df: DataFrame, name: str = "record") -> Column:
    """Struct of every column."""
    return F.struct(*[F.col(c) for c in df.columns]).alias(name)
