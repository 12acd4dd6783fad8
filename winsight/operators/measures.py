"""Per-window measures (M1-M8) as mergeable partial aggregates.

Every measure is declared as a handful of *partials* (count, sum, min, max,
conditional count) that Spark can combine map-side and merge across levels
(pane -> window, bucket -> session, value -> window).  A final expression turns
the merged partials into the measure value.  Uniqueness is the one measure
that is not mergeable; the plan compiler gives it an extra grouping level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

N = "_n"  # count(*) partial, always present


@dataclass(frozen=True)
class Partial:
    name: str
    expr: Column = field(compare=False, hash=False)
    merge: str  # "sum" | "min" | "max"
    row: Column | None = field(default=None, compare=False, hash=False)  # its value for a single row

    def of_row(self) -> Column:
        if self.row is None:
            raise ValueError(f"partial {self.name} has no value for a single row")
        return self.row

    def merged(self, src: str | None = None) -> Column:
        c = F.col(src or self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.merge](c).alias(self.name)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 (ANSI-safe)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def _key(values) -> str:
    return hashlib.sha1(repr(tuple(values)).encode()).hexdigest()[:8]


@dataclass(frozen=True)
class Measure:
    """One measure over a column.  ``kind`` is one of :data:`KINDS`."""

    kind: str
    column: str | None = None
    values: tuple = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown measure {self.kind!r}")
        if self.kind != "size" and not self.column:
            raise ValueError(f"measure {self.kind} needs a column")
        object.__setattr__(self, "values", tuple(self.values))

    # -- partials -------------------------------------------------------
    def partials(self, whole=frozenset()) -> list[Partial]:
        """``whole``: columns of whole numbers; they are summed as decimals, which cannot overflow."""
        c = F.col(self.column) if self.column else None
        k, name = self.kind, self.column
        summed = c.cast("decimal(19,0)") if name in whole else c
        one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
        if k == "size":
            return []
        if k == "count":
            return [Partial(f"_nn__{name}", F.count(c), "sum", one(c.isNotNull()))]
        if k == "max":
            return [Partial(f"_max__{name}", F.max(c), "max", c)]
        if k == "min":
            return [Partial(f"_min__{name}", F.min(c), "min", c)]
        if k == "mean":
            return [Partial(f"_sum__{name}", F.sum(summed), "sum", summed), Partial(f"_nn__{name}", F.count(c), "sum", one(c.isNotNull()))]
        if k == "sum":
            return [Partial(f"_sum__{name}", F.sum(summed), "sum", summed)]
        if k == "completeness":
            return [Partial(f"_nn__{name}", F.count(c), "sum", one(c.isNotNull()))]
        if k == "conformance":
            return [Partial(f"_in__{name}__{_key(self.values)}", F.count_if(c.isin(list(self.values))), "sum", one(c.isin(list(self.values)))),
                    Partial(f"_nn__{name}", F.count(c), "sum", one(c.isNotNull()))]
        if k == "outside":
            return [Partial(f"_out__{name}__{_key(self.values)}",
                            F.count_if(c.isNotNull() & ~c.isin(list(self.values))), "sum",
                            one(c.isNotNull() & ~c.isin(list(self.values))))]
        if k == "negatives":
            return [Partial(f"_neg__{name}", F.count_if(c < 0), "sum", one(c < 0))]
        if k == "unique":
            return [Partial(f"_nn__{name}", F.count(c), "sum", one(c.isNotNull()))]
        raise AssertionError(k)

    # -- final value ----------------------------------------------------
    def value(self) -> Column:
        k, name = self.kind, self.column
        if k == "size":
            return F.col(N)
        if k in ("count",):
            return F.col(f"_nn__{name}")
        if k in ("max", "min"):
            return F.col(f"_{k}__{name}")
        if k == "mean":
            return ratio(F.col(f"_sum__{name}"), F.col(f"_nn__{name}"))
        if k == "sum":
            return F.col(f"_sum__{name}")
        if k == "completeness":
            return ratio(F.col(f"_nn__{name}"), F.col(N))
        if k == "conformance":
            return ratio(F.col(f"_in__{name}__{_key(self.values)}"), F.col(f"_nn__{name}"))
        if k == "outside":
            return F.col(f"_out__{name}__{_key(self.values)}")
        if k == "negatives":
            return F.col(f"_neg__{name}")
        if k == "unique":
            return ratio(F.col(f"_uq1__{name}"), F.col(f"_uqn__{name}"))
        raise AssertionError(k)


KINDS = ("size", "count", "max", "min", "mean", "sum", "completeness", "conformance",
         "outside", "negatives", "unique")


# -- public constructors (the monitor's measure vocabulary) ---------------
def size() -> Measure:
    """M1: rows in the window."""
    return Measure("size")


def count(column: str) -> Measure:
    """M2: non-null values of ``column``."""
    return Measure("count", column)


def max(column: str) -> Measure:  # noqa: A001 - mirrors the measure name
    """M3: largest value, null when the column is all null."""
    return Measure("max", column)


def min(column: str) -> Measure:  # noqa: A001
    """M4: smallest value, null when the column is all null."""
    return Measure("min", column)


def mean(column: str) -> Measure:
    """M5: mean over non-null values."""
    return Measure("mean", column)


def fraction_of_unique(column: str) -> Measure:
    """M6: values occurring exactly once / non-null values; null if none."""
    return Measure("unique", column)


def fraction_of_set_conformance(column: str, allowed) -> Measure:
    """M7: non-null values inside ``allowed`` / non-null values; null if none."""
    return Measure("conformance", column, tuple(allowed))


def completeness(column: str) -> Measure:
    """M8: non-null values / rows."""
    return Measure("completeness", column)


def outside_count(column: str, allowed) -> Measure:
    """Non-null values outside ``allowed`` (basis of ``is_contained_in``)."""
    return Measure("outside", column, tuple(allowed))


def negative_count(column: str) -> Measure:
    """Values below zero (basis of ``is_non_negative``)."""
    return Measure("negatives", column)

