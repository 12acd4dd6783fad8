"""Constraints (C1-C8): a measure plus a predicate on its value.

The verdict is ``coalesce(predicate(value), false)``: a window with no value
for the measure fails the constraint.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import measures as M

Predicate = Callable[[Column], Column]


@dataclass(frozen=True)
class Constraint:
    name: str
    measure: M.Measure
    predicate: Predicate = field(compare=False)

    def verdict(self, value: Column) -> Column:
        return F.coalesce(self.predicate(value), F.lit(False))


def is_complete(column: str, name: str | None = None) -> Constraint:
    """completeness = 1."""
    return Constraint(name or f"is_complete_{column}", M.completeness(column), lambda v: v == 1.0)


def is_unique(column: str, name: str | None = None) -> Constraint:
    """Every non-null value occurs once (unique fraction = 1)."""
    return Constraint(name or f"is_unique_{column}", M.fraction_of_unique(column), lambda v: v == 1.0)


def has_max(column: str, predicate: Predicate, name: str | None = None) -> Constraint:
    """Predicate on the maximum."""
    return Constraint(name or f"has_max_{column}", M.max(column), predicate)


def has_min(column: str, predicate: Predicate, name: str | None = None) -> Constraint:
    """C4: predicate on the minimum."""
    return Constraint(name or f"has_min_{column}", M.min(column), predicate)


def has_mean(column: str, predicate: Predicate, name: str | None = None) -> Constraint:
    """Predicate on the mean."""
    return Constraint(name or f"has_mean_{column}", M.mean(column), predicate)


def has_completeness(column: str, predicate: Predicate, name: str | None = None) -> Constraint:
    """Predicate on completeness."""
    return Constraint(name or f"has_completeness_{column}", M.completeness(column), predicate)


def is_contained_in(column: str, allowed, name: str | None = None) -> Constraint:
    """No non-null value outside ``allowed`` (nulls pass)."""
    return Constraint(name or f"is_contained_in_{column}", M.outside_count(column, allowed), lambda v: v == 0)


def is_non_negative(column: str, name: str | None = None) -> Constraint:
    """No value below zero (nulls pass)."""
    return Constraint(name or f"is_non_negative_{column}", M.negative_count(column), lambda v: v == 0)
