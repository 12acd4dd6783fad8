"""Shared text expressions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The character classes of the operators' contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither an ASCII letter or digit nor beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """``_doc`` (every column of ``docs``) and the ``extra`` columns, so that no name of the input can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *[e.alias(n) for n, e in extra.items()])


def unpacked(names: list[str]) -> list[Column]:
    """The columns back again."""
    return [F.col("_doc").getField(n).alias(n) for n in names]


def unlike(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters beyond ASCII keep their case."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def space_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, as they are; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
