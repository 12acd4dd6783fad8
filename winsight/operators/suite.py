"""Check suites (C9-C11) and result records.

A suite compiles to *one* windowed aggregation: every measure its
constraints need is computed in the same ``groupBy``, and verdicts plus the
failed count are plain projections on top.  Nothing is collected; the result
is one row per (tags, window).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import WindowSpec
from ..plans.aggregate import WS, WE, check_names, windowed_measures
from . import constraints as C
from . import measures as M

SIZE = "batch_size"
FAILED = "num_failed"


class Suite:
    """Named list of constraints, e.g.::

        Suite("Reddit checks").is_complete("id_").is_unique("id_") \
            .has_min("downs", lambda v: v >= 0)
    """

    def __init__(self, name: str = "checks", level: str = "Error", constraints=()):
        self.name, self.level = name, level
        self.constraints: list[C.Constraint] = list(constraints)

    def add(self, constraint: C.Constraint) -> "Suite":
        taken = {SIZE, FAILED} | {n for c in self.constraints for n in (c.name, f"{c.name}_ok")}
        if {constraint.name, f"{constraint.name}_ok"} & taken:
            raise ValueError(f"duplicate constraint name {constraint.name!r}")
        check_names([constraint.name, f"{constraint.name}_ok"], ())
        self.constraints.append(constraint)
        return self

    # chained builders -------------------------------------------------
    def is_complete(self, column, name=None):
        return self.add(C.is_complete(column, name))

    def is_unique(self, column, name=None):
        return self.add(C.is_unique(column, name))

    def has_max(self, column, predicate, name=None):
        return self.add(C.has_max(column, predicate, name))

    def has_min(self, column, predicate, name=None):
        return self.add(C.has_min(column, predicate, name))

    def has_mean(self, column, predicate, name=None):
        return self.add(C.has_mean(column, predicate, name))

    def has_completeness(self, column, predicate, name=None):
        return self.add(C.has_completeness(column, predicate, name))

    def is_contained_in(self, column, allowed, name=None):
        return self.add(C.is_contained_in(column, allowed, name))

    def is_non_negative(self, column, name=None):
        return self.add(C.is_non_negative(column, name))

    # evaluation -------------------------------------------------------
    def measures(self) -> dict[str, M.Measure]:
        out = {SIZE: M.size()}
        out.update({c.name: c.measure for c in self.constraints})
        return out

    def evaluate(self, df: DataFrame, window: WindowSpec, time_col: str, tags=(),
                 *, watermark: str | None = None) -> DataFrame:
        """C9 + C10: tags, window bounds, batch_size, per-constraint value and
        ``<name>_ok`` verdict, and ``num_failed``."""
        if not self.constraints:
            raise ValueError("suite has no constraints")
        check_names([*self.measures(), FAILED, *[f"{c.name}_ok" for c in self.constraints]], tags)
        return self.finish(windowed_measures(df, window, time_col, self.measures(), tags, watermark=watermark))

    def stream_sessions(self, spark, window: WindowSpec, time_col: str, tags=(), *, delay_ms: int = 0,
                        base: str | None = None):
        """Streaming session windows with any constraint, uniqueness included:
        a ``foreachBatch`` processor (``.start(stream)``, ``.result()``)."""
        from ..streaming.sessions import SessionMeasures
        return SessionMeasures(spark, window, time_col, self.measures(), tags, delay_ms=delay_ms,
                               post=self.finish, base=base)

    def finish(self, measured: DataFrame) -> DataFrame:
        """Verdicts and ``num_failed`` on top of a table of this suite's measures."""
        oks = [c.verdict(F.col(c.name)).alias(f"{c.name}_ok") for c in self.constraints]
        failed = reduce(lambda a, b: a + b, [(~F.col(f"{c.name}_ok")).cast("long") for c in self.constraints])
        return measured.select("*", *oks).withColumn(FAILED, failed)

    def verdict_rows(self, result: DataFrame, keep=()) -> DataFrame:
        """C11: one row per (window, constraint) with value (double) and verdict.

        A value that is no number (the maximum of a text or time column) has a
        null ``value``; where a constraint of the suite measures such a
        column, a further column ``text_value`` shows every value as text.
        """
        texts = [c.name for c in self.constraints if not isinstance(result.schema[c.name].dataType, (T.NumericType, T.BooleanType))]

        def item(c):
            value = F.col(c.name)
            number = F.lit(None).cast("double") if c.name in texts else value.cast("double")
            shown = [value.cast("string").alias("text_value")] if texts else []
            return F.struct(F.lit(c.name).alias("constraint"), number.alias("value"), F.col(f"{c.name}_ok").alias("ok"), *shown)

        return result.select(*keep, WS, WE, F.inline(F.array(*[item(c) for c in self.constraints])))


def window_result(result: DataFrame, window: WindowSpec, constants: dict | None = None,
                  keep=()) -> DataFrame:
    """Result record per (tag, window) -- bounds, window type and duration,
    batch size, failed count, ``time`` (epoch ms at which the record was made;
    in a stream, of its micro-batch), plus run constants (e.g. core count)."""
    cols: list[Column] = [F.col(k) for k in keep]
    cols += [F.col(WS), F.col(WE), F.lit(window.kind).alias("window_type"),
             F.lit(window.duration if window.kind != "session" else window.gap).alias("window_duration"),
             F.col(SIZE), F.col(FAILED), F.unix_millis(F.current_timestamp()).alias("time")]
    cols += [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return result.select(*cols)


def union_results(*frames: DataFrame) -> DataFrame:
    """R2: accumulate result records (by column name, each row once)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
