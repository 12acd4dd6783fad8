"""

Every query reads the driver's tables (mostly ``events``; ``orders`` for
casts) over their whole extent.  Mapping used by the suites, standing in for
the reference's record fields: id -> ``user_id``, priority -> ``event_type``
(``'error'`` read as a missing value), numViews/downs -> ``value``.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winsight import Suite, WindowSpec, windowed_measures
from winsight.functions.casts import rename_if_present, safe_cast, tag_constants
from winsight.functions.labels import route_by_key, window_label
from winsight.functions.time import epoch_ms, epoch_s, floor_div, from_micros, parse_ts, to_micros
from winsight.operators import measures as M
from winsight.operators.batches import assign_batches, batch_markers
from winsight.operators.runs import (classify, latest_by_run, run_elapsed, run_stats, run_summary,
                                     segment_by_marker, source_totals, weighted_rows)
from winsight.operators.suite import union_results, window_result
from winsight.operators.windows import assign_windows, collect_rows, distinct_windows, rows_of_window
from winsight.monitor import Monitor
from winsight.session import age_in_order, remove_path, scratch_path, written_files
from winsight.sources.files import parent_dir, read_records_csv, read_run_start, read_timings_csv, read_values_text
from winsight.sources.messages import decode_json, read_messages, stream_table, to_messages
from winsight.sources.sinks import append_summary, write_results
from winsight.streaming.batches import BatchTags, stream_batch_markers
from winsight.streaming.sessions import SessionMeasures
from winsight.streaming.sliding import stream_sliding
from winsight.streaming.state import run_stateful
from winsight.streaming.suites import run_available
from winsight.streaming.summary import SummaryStream

SMOKE_DIR = "/root/testdata/sf0.001"
ALLOWED = ("click", "view")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_amount(df: DataFrame) -> DataFrame:
    """``amount``: the two-decimal ``value`` as an exact decimal, so sums and
    means do not depend on the order Spark adds partial results."""
    return df.withColumn("amount", F.col("value").cast("decimal(12,2)"))


def _events_with_gaps(spark, sf_dir) -> DataFrame:
    """events plus ``kind`` (event_type with 'error' read as missing) and ``amount``."""
    ev = _t(spark, sf_dir, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    return _with_amount(ev)


# ---------------------------------------------------------------- suites
BASIC = {
    "n": M.size(), "mx": M.max("value"), "mn": M.min("value"),
    "frac": M.fraction_of_set_conformance("event_type", ALLOWED), "uniq": M.fraction_of_unique("user_id"),
}


def q_tumbling_suite(spark, sf_dir):
    return windowed_measures(_t(spark, sf_dir, "events"), WindowSpec.tumbling("60 minutes"), "ts", BASIC)


def q_sliding_suite(spark, sf_dir):
    return windowed_measures(_t(spark, sf_dir, "events"), WindowSpec.sliding("60 minutes", "15 minutes"), "ts", BASIC)


def q_sliding_measures(spark, sf_dir):
    """Mergeable measures only: the pane plan (rows aggregated once, panes fanned out)."""
    ms = {k: v for k, v in BASIC.items() if k != "uniq"}
    return Monitor(WindowSpec.sliding("60 minutes", "15 minutes"), "ts", source=_t(spark, sf_dir, "events"), measures=ms).run()


def q_session_counts(spark, sf_dir):
    return windowed_measures(_t(spark, sf_dir, "events"), WindowSpec.session("120 minutes"), "ts",
                             {"n": M.size()}, tags=["user_id"])


def q_session_unique(spark, sf_dir):
    return windowed_measures(_t(spark, sf_dir, "events"), WindowSpec.session("120 minutes"), "ts",
                             {"n": M.size(), "u": M.fraction_of_unique("event_type")}, tags=["user_id"])


def q_measures_all(spark, sf_dir):
    ms = {
        "n": M.size(), "cnt": M.count("kind"), "mx": M.max("value"), "mn": M.min("value"),
        "avg_value": M.mean("amount"), "uniq": M.fraction_of_unique("user_id"),
        "conf": M.fraction_of_set_conformance("kind", ALLOWED), "compl": M.completeness("kind"),
    }
    return windowed_measures(_events_with_gaps(spark, sf_dir), WindowSpec.tumbling("1440 minutes"), "ts", ms)


def reddit_like_suite() -> Suite:
    return (Suite("Reddit-like checks")
            .is_complete("kind", name="id_complete")
            .is_unique("user_id", name="id_unique")
            .has_min("value", lambda v: v >= 1, name="min_value")
            .has_mean("amount", lambda v: v < 50, name="mean_value")
            .has_completeness("kind", lambda v: v > 0.9, name="kind_completeness"))


def products_like_suite() -> Suite:
    return (Suite("Products-like checks")
            .is_complete("kind", name="id_complete")
            .is_unique("event_id", name="id_unique")
            .has_max("value", lambda v: v < 90, name="max_value")
            .is_contained_in("kind", ALLOWED, name="kind_allowed")
            .is_non_negative("value", name="value_non_negative"))


def q_checks_reddit_like(spark, sf_dir):
    return reddit_like_suite().evaluate(_events_with_gaps(spark, sf_dir), WindowSpec.tumbling("60 minutes"), "ts")


def q_checks_products_like(spark, sf_dir):
    return products_like_suite().evaluate(_events_with_gaps(spark, sf_dir), WindowSpec.tumbling("1440 minutes"),
                                          "ts", tags=["user_id"])


def q_tagged_suite(spark, sf_dir):
    ms = {"n": M.size(), "mx": M.max("value"), "avg_value": M.mean("amount"), "uniq": M.fraction_of_unique("user_id")}
    return windowed_measures(_with_amount(_t(spark, sf_dir, "events")), WindowSpec.tumbling("360 minutes"), "ts", ms,
                             tags=["event_type"])


def q_verdict_rows(spark, sf_dir):
    suite = reddit_like_suite()
    res = suite.evaluate(_events_with_gaps(spark, sf_dir), WindowSpec.tumbling("60 minutes"), "ts")
    return suite.verdict_rows(res)


# ---------------------------------------------------------------- streaming
def q_stream_tumbling(spark, sf_dir):
    mon = Monitor(HOUR, time_column="ts", wait_for_late=0, source=stream_table(spark, sf_dir, "events"))
    for name, m in BASIC.items():
        mon.add(m, name)
    return run_available(spark, mon.plan(), "stream_tumbling")


def q_stream_session(spark, sf_dir):
    mon = (Monitor(WindowSpec.session("120 minutes"), time_column="ts", tags=("user_id",),
                   source=stream_table(spark, sf_dir, "events"))
           .add(M.size(), "n").add(M.max("value"), "mx").add(M.min("value"), "mn"))
    return run_available(spark, mon.plan(), "stream_session")


#: Every file of the ordered streams is a micro-batch: at least 4 files, from there one per ``STREAM_ROWS`` rows up to 8,
#: and more than 8 only where a file would pass ``STREAM_MOST_ROWS``.
STREAM_ROWS, STREAM_FILES, STREAM_MOST_ROWS = 25_000, (4, 8), 1_000_000
ROW_GROUP_BYTES = 1 << 20
#: Parts of the keyed state of the sliding stream.
STREAM_PARTITIONS = 4


def stream_files(n: int) -> int:
    """Micro-batches for ``n`` rows: each costs a fixed time, so their number grows with the rows only where it bounds a micro-batch."""
    least, usual = STREAM_FILES
    return max(least, min(usual, -(-n // STREAM_ROWS)), -(-n // STREAM_MOST_ROWS))


def ordered_stream(spark, sf_dir, order) -> DataFrame:
    """The whole of ``events`` as files in the order of ``order`` (a long), one per micro-batch.

    All files are written in one job, a task each.  A file source takes files
    by age, so their times are set in the order of their rows; a store that
    keeps no set times gets them again, one after the other.  Rows of equal
    ``order`` share a file, rows without one have no place.  Within a file
    rows are in order, so that each of the tasks that read it has a stretch
    of its own.
    """
    ev = _t(spark, sf_dir, "events")
    placed = ev.withColumn("_at", order).where(F.col("_at").isNotNull())
    files = stream_files(placed.count())
    path = scratch_path(spark, "ordered")
    _write_stream_files(placed.repartitionByRange(files, "_at").sortWithinPartitions("_at").drop("_at"), path)
    parts = written_files(spark, path)
    if not age_in_order(spark, parts):
        cut, path = path, scratch_path(spark, "ordered")
        for part in parts:
            _write_stream_files(spark.read.schema(ev.schema).parquet(part).coalesce(1), path)
        remove_path(spark, cut)
    return read_messages(spark, "parquet", {"maxFilesPerTrigger": 1}, path=path, schema=ev.schema)


def _write_stream_files(df: DataFrame, path: str) -> None:
    # small row groups, so that several tasks read a file
    df.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def q_stream_session_unique(spark, sf_dir):
    """Session windows with uniqueness over a stream: carried bucket partials (foreachBatch)."""
    ms = {"n": M.size(), "u": M.fraction_of_unique("event_type")}
    proc = SessionMeasures(spark, WindowSpec.session("120 minutes"), "ts", ms, ["user_id"])
    q = proc.start(ordered_stream(spark, sf_dir, to_micros("ts", T.TimestampNTZType())), trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return proc.result().drop("batch_id")


#: Seconds by which the rows of the sliding stream arrive out of order, at most; the stream waits as long.
JITTER_S = 2700


def shuffled_stream(spark, sf_dir) -> DataFrame:
    """``events`` in the order of event time plus up to ``JITTER_S``: out of order, never late."""
    jitter = F.pmod(F.col("event_id") * 7919, F.lit(JITTER_S)) * 1_000_000
    return ordered_stream(spark, sf_dir, to_micros("ts", T.TimestampNTZType()) + jitter)


def q_stream_sliding(spark, sf_dir):
    """Sliding windows over rows out of order: pane partials in keyed state, timers at window ends."""
    ms = {"n": M.size(), "mx": M.max("value"), "mn": M.min("value"), "avg_value": M.mean("amount"),
          "frac": M.fraction_of_set_conformance("event_type", ALLOWED)}
    out = stream_sliding(_with_amount(shuffled_stream(spark, sf_dir)), WindowSpec.sliding("60 minutes", "15 minutes"), "ts", ms,
                         watermark=f"{JITTER_S} seconds")
    return run_stateful(out, "stream_sliding", STREAM_PARTITIONS)


def q_stream_batches(spark, sf_dir):
    """Batch numbers carried over micro-batches."""
    tags = BatchTags(spark, "event_id", SIZES)
    tags.start(ordered_stream(spark, sf_dir, F.col("event_id").cast("long")).select("event_id"), {"availableNow": True}).awaitTermination()
    return tags.result().select("event_id", "batch_id")


def q_stream_batch_markers(spark, sf_dir):
    """A marker per batch, as it fills."""
    ev = ordered_stream(spark, sf_dir, F.col("event_id").cast("long"))
    return run_stateful(stream_batch_markers(ev, SIZES), "stream_batch_markers", 1)


def q_stream_tumbling_unique2(spark, sf_dir):
    """Three uniqueness columns in one streaming query."""
    ms = {"n": M.size(), "mx": M.max("value"), "u_user": M.fraction_of_unique("user_id"),
          "u_value": M.fraction_of_unique("value"), "u_kind": M.fraction_of_unique("event_type")}
    return run_available(spark, windowed_measures(stream_table(spark, sf_dir, "events"), HOUR, "ts", ms), "stream_tumbling_unique2")


def q_stream_collect_rows(spark, sf_dir):
    """Bags of rows over a stream, in chunks by event id."""
    bags = collect_rows(stream_table(spark, sf_dir, "events"), HOUR, "ts", chunk_rows=64, chunk_by="event_id")
    return bag_totals(run_available(spark, bags, "stream_collect_rows"))


def q_stream_distinct_windows(spark, sf_dir):
    w = assign_windows(stream_table(spark, sf_dir, "events"), WindowSpec.tumbling("360 minutes"), "ts", watermark="0 seconds")
    return run_available(spark, distinct_windows(w, ["event_type"]), "stream_distinct_windows")


def q_stream_summary(spark, sf_dir):
    summary = SummaryStream(spark, MARKER, SOURCES, DEFAULT_SOURCE, RUN_CONSTANTS)
    q = summary.start(messages_of(ordered_stream(spark, sf_dir, F.col("event_id").cast("long"))), trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return summary.result()


# ---------------------------------------------------------------- files
def q_csv_roundtrip(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "records_csv")
    write_results(ev, path, "csv")
    return read_records_csv(spark, path, ev.schema)


def q_timings_csv(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "timings")
    (ev.select("event_id", "user_id", _ms("ts").alias("timestamp"), F.col("event_type").alias("run"))
       .write.partitionBy("run").option("header", False).csv(path))
    t = read_timings_csv(spark, path, "three").withColumn("run", F.substring_index(parent_dir("file"), "=", -1))
    return t.groupBy("run").agg(F.max("timestamp").alias("latest"), F.count(F.lit(1)).alias("n"))


def q_text_values(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "values_txt")
    (ev.select(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("line"),
               F.col("event_type").alias("run")).write.partitionBy("run").text(path))
    vals = read_values_text(spark, path).withColumn("run", F.regexp_extract("file", "run=([^/]+)/", 1))
    st = run_stats(_with_amount(vals), "run", "amount")
    return st.withColumn("std", F.round("std", 6))


def q_run_report(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "run_report")
    ev.agg(F.min(_ms("ts")).cast("string").alias("start")).write.json(path)
    # the report holds one start time: read it as a scalar subquery
    start = read_run_start(spark, path).agg(F.min("start")).scalar()
    return run_elapsed(latest_by_run(_timings(spark, sf_dir)), start, elements=100, sleep=2.0)


def q_summary_csv(spark, sf_dir):
    summary = run_summary(event_messages(spark, sf_dir), MARKER, SOURCES, DEFAULT_SOURCE, RUN_CONSTANTS)
    path = scratch_path(spark, "summary_csv")
    append_summary(summary, path, "csv")
    return spark.read.schema(summary.schema).option("header", True).csv(path)


# ---------------------------------------------------------------- oracles
_HOUR = "time_bucket(interval 1 hour, ts, timestamp '1970-01-01')"

SQL_TUMBLING = f"""
with p as (select {_HOUR} ws, user_id, count(*) c, max(value) mx, min(value) mn,
                  count(*) filter (where event_type in ('click','view')) ok
           from events where ts is not null group by 1, 2)
select ws window_start, ws + interval 1 hour window_end, cast(sum(c) as bigint) n, max(mx) mx, min(mn) mn,
       sum(ok) / sum(c) frac,
       sum(case when user_id is not null and c = 1 then 1 else 0 end)
         / nullif(sum(case when user_id is not null then c else 0 end), 0) uniq
from p group by 1
"""

SQL_SLIDING_MEASURES = """
with x as (select *, time_bucket(interval 15 minute, ts, timestamp '1970-01-01') - to_minutes(15 * k) ws
           from events, range(4) r(k) where ts is not null)
select ws window_start, ws + interval 1 hour window_end, count(*) n, max(value) mx, min(value) mn,
       count(*) filter (where event_type in ('click','view')) / count(*) frac
from x group by 1
"""

SQL_STREAM_SLIDING = f"""
with x as (select *, time_bucket(interval 15 minute, ts, timestamp '1970-01-01') - to_minutes(15 * k) ws
           from events, range(4) r(k) where ts is not null)
select ws window_start, ws + interval 1 hour window_end, count(*) n, max(value) mx, min(value) mn,
       cast(sum(cast(value as decimal(12, 2))) as double) / nullif(count(value), 0) avg_value,
       count(*) filter (where event_type in ('click','view')) / nullif(count(event_type), 0) frac
from x group by 1 having ws + interval 1 hour <= (select max(ts) from events) - to_seconds({JITTER_S})
"""

SQL_SLIDING = """
with x as (select *, time_bucket(interval 15 minute, ts, timestamp '1970-01-01') - to_minutes(15 * k) ws
           from events, range(4) r(k) where ts is not null),
p as (select ws, user_id, count(*) c, max(value) mx, min(value) mn,
             count(*) filter (where event_type in ('click','view')) ok from x group by 1, 2)
select ws window_start, ws + interval 1 hour window_end, cast(sum(c) as bigint) n, max(mx) mx, min(mn) mn,
       sum(ok) / sum(c) frac,
       sum(case when user_id is not null and c = 1 then 1 else 0 end)
         / nullif(sum(case when user_id is not null then c else 0 end), 0) uniq
from p group by 1
"""

_SESSIONS = """
with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hour
                          then 0 else 1 end nw from events where ts is not null),
b as (select *, sum(nw) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) sid from a)
"""

SQL_SESSION_COUNTS = _SESSIONS + """
select user_id, min(ts) window_start, max(ts) + interval 2 hour window_end, count(*) n from b group by user_id, sid
"""

SQL_SESSION_UNIQUE = _SESSIONS + """,
d as (select user_id, sid, event_type, count(*) c, min(ts) t, max(ts) tx from b group by 1, 2, 3)
select user_id, min(t) window_start, max(tx) + interval 2 hour window_end, cast(sum(c) as bigint) n,
       sum(case when event_type is not null and c = 1 then 1 else 0 end)
         / nullif(sum(case when event_type is not null then c else 0 end), 0) u
from d group by user_id, sid
"""

_GAPS = ("(select *, nullif(event_type, 'error') kind, cast(value as decimal(12, 2)) amount "
         "from events where ts is not null)")

SQL_MEASURES_ALL = f"""
with p as (select time_bucket(interval 1 day, ts, timestamp '1970-01-01') ws, user_id, count(*) c,
                  count(kind) nn, max(value) mx, min(value) mn, sum(amount) sv, count(amount) nv,
                  count(*) filter (where kind in ('click','view')) ok
           from {_GAPS} g group by 1, 2)
select ws window_start, ws + interval 1 day window_end, cast(sum(c) as bigint) n, cast(sum(nn) as bigint) cnt,
       max(mx) mx, min(mn) mn, cast(sum(sv) as double) / nullif(sum(nv), 0) avg_value,
       sum(case when user_id is not null and c = 1 then 1 else 0 end)
         / nullif(sum(case when user_id is not null then c else 0 end), 0) uniq,
       sum(ok) / nullif(sum(nn), 0) conf, sum(nn) / sum(c) compl
from p group by 1
"""

_REDDIT_MEASURES = f"""
with p as (select {_HOUR} ws, user_id, count(*) c, count(kind) nn, min(value) mn, sum(amount) sv, count(amount) nv
           from {_GAPS} g group by 1, 2),
w as (select ws, cast(sum(c) as bigint) batch_size,
             sum(nn) / sum(c) id_complete,
             sum(case when user_id is not null and c = 1 then 1 else 0 end)
               / nullif(sum(case when user_id is not null then c else 0 end), 0) id_unique,
             min(mn) min_value, cast(sum(sv) as double) / nullif(sum(nv), 0) mean_value_raw,
             sum(nn) / sum(c) kind_completeness
      from p group by 1),
v as (select *, coalesce(id_complete = 1, false) id_complete_ok, coalesce(id_unique = 1, false) id_unique_ok,
             coalesce(min_value >= 1, false) min_value_ok, coalesce(mean_value_raw < 50, false) mean_value_ok,
             coalesce(kind_completeness > 0.9, false) kind_completeness_ok from w)
"""

SQL_CHECKS_REDDIT = _REDDIT_MEASURES + """
select ws window_start, ws + interval 1 hour window_end, batch_size, id_complete, id_unique, min_value,
       mean_value_raw mean_value, kind_completeness, id_complete_ok, id_unique_ok, min_value_ok,
       mean_value_ok, kind_completeness_ok,
       cast((not id_complete_ok)::int + (not id_unique_ok)::int + (not min_value_ok)::int
            + (not mean_value_ok)::int + (not kind_completeness_ok)::int as bigint) num_failed
from v
"""

SQL_VERDICT_ROWS = _REDDIT_MEASURES + """
select ws window_start, ws + interval 1 hour window_end, 'id_complete' "constraint", cast(id_complete as double) "value", id_complete_ok ok from v
union all select ws, ws + interval 1 hour, 'id_unique', cast(id_unique as double), id_unique_ok from v
union all select ws, ws + interval 1 hour, 'min_value', cast(min_value as double), min_value_ok from v
union all select ws, ws + interval 1 hour, 'mean_value', cast(mean_value_raw as double), mean_value_ok from v
union all select ws, ws + interval 1 hour, 'kind_completeness', cast(kind_completeness as double), kind_completeness_ok from v
"""

def _products_sql(tag: str | None, bucket: str = "1 day") -> str:
    t = f"{tag}, " if tag else ""
    return f"""
with p as (select {t}time_bucket(interval {bucket}, ts, timestamp '1970-01-01') ws, event_id, count(*) c,
                  count(kind) nn, max(value) mx,
                  count(*) filter (where kind is not null and kind not in ('click','view')) bad,
                  count(*) filter (where value < 0) neg
           from {_GAPS} g group by all),
w as (select {t}ws, cast(sum(c) as bigint) batch_size, sum(nn) / sum(c) id_complete,
             sum(case when event_id is not null and c = 1 then 1 else 0 end)
               / nullif(sum(case when event_id is not null then c else 0 end), 0) id_unique,
             max(mx) max_value, cast(sum(bad) as bigint) kind_allowed, cast(sum(neg) as bigint) value_non_negative
      from p group by all),
v as (select *, coalesce(id_complete = 1, false) id_complete_ok, coalesce(id_unique = 1, false) id_unique_ok,
             coalesce(max_value < 90, false) max_value_ok, coalesce(kind_allowed = 0, false) kind_allowed_ok,
             coalesce(value_non_negative = 0, false) value_non_negative_ok from w)
select {t}ws window_start, ws + interval {bucket} window_end, batch_size, id_complete, id_unique, max_value,
       kind_allowed, value_non_negative, id_complete_ok, id_unique_ok, max_value_ok, kind_allowed_ok,
       value_non_negative_ok,
       cast((not id_complete_ok)::int + (not id_unique_ok)::int + (not max_value_ok)::int
            + (not kind_allowed_ok)::int + (not value_non_negative_ok)::int as bigint) num_failed
from v
"""


SQL_CHECKS_PRODUCTS = _products_sql("user_id")

SQL_TAGGED = """
with p as (select event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') ws, user_id, count(*) c,
                  max(value) mx, sum(cast(value as decimal(12, 2))) sv, count(value) nv
           from events where ts is not null group by 1, 2, 3)
select event_type, ws window_start, ws + interval 6 hour window_end, cast(sum(c) as bigint) n, max(mx) mx,
       cast(sum(sv) as double) / nullif(sum(nv), 0) avg_value,
       sum(case when user_id is not null and c = 1 then 1 else 0 end)
         / nullif(sum(case when user_id is not null then c else 0 end), 0) uniq
from p group by 1, 2
"""


# ---------------------------------------------------------------- row-level windows, filters
HOUR = WindowSpec.tumbling("60 minutes")


def q_assign_sliding(spark, sf_dir):
    w = assign_windows(_t(spark, sf_dir, "events"), WindowSpec.sliding("60 minutes", "15 minutes"), "ts")
    return w.select("event_id", "window_start", "window_end")


def q_distinct_windows(spark, sf_dir):
    w = assign_windows(_t(spark, sf_dir, "events"), WindowSpec.tumbling("360 minutes"), "ts")
    return distinct_windows(w, ["event_type"])


def q_rows_of_window(spark, sf_dir):
    w = assign_windows(_t(spark, sf_dir, "events"), HOUR, "ts")
    start, end = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 01:00:00").cast("timestamp_ntz")
    rows = rows_of_window(w, start, end, {"event_type": "click"}, time_col="ts")
    return rows.select("event_id", "user_id", "value")


def q_collect_rows(spark, sf_dir):
    return bag_totals(collect_rows(_t(spark, sf_dir, "events"), HOUR, "ts", chunk_rows=64))


def bag_totals(bags: DataFrame) -> DataFrame:
    per_chunk = bags.select("window_start", "window_end", F.size("rows").alias("k"),
                            F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r["event_id"]).alias("s"))
    return per_chunk.groupBy("window_start", "window_end").agg(
        F.sum("k").cast("long").alias("n_rows"), F.sum("s").cast("long").alias("id_sum"))


# ---------------------------------------------------------------- ingest and casts
def _ms(c):
    return floor_div(to_micros(c, T.TimestampNTZType()), 1000)


def q_json_decode(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    msgs = ev.select("event_id", F.col("props").cast("binary").alias("value"))
    # k declared double: a nullable number column reads the same from every engine
    schema = T.StructType([T.StructField("k", T.DoubleType())])
    return decode_json(msgs, schema, keep=["event_id"])


def _utc_wall_clock(c):
    """Present an instant as its UTC wall-clock time (zone-free, like DuckDB's TIMESTAMP)."""
    return from_micros(to_micros(c, T.TimestampType()), T.TimestampNTZType())


def q_epoch_ms(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", _ms("ts").alias("ms"))
    return ev.select("event_id", "ms", _utc_wall_clock(epoch_ms("ms")).alias("ts_ms"))


def q_epoch_s(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select(
        "event_id", floor_div(to_micros("ts", T.TimestampNTZType()), 1_000_000).alias("s"))
    return ev.select("event_id", "s", _utc_wall_clock(epoch_s("s")).alias("ts_s"))


def q_parse_ts(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.lit("bad")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("text")
    # the text is a wall-clock time, so it is read back as one (no session-zone shift)
    return ev.select("event_id", text).select("event_id", "text",
                                              parse_ts("text").cast("timestamp_ntz").alias("parsed"))


def q_safe_cast(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("key_text"),
        F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"))
    return safe_cast(o, {"key_text": "bigint", "prio": "bigint", "status": "bigint", "absent": "bigint"})


def q_safe_cast_typed(spark, sf_dir):
    """Typed columns: a double to whole numbers and a boolean to a number."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("price"),
                                           (F.col("o_totalprice") > 100000).alias("large"))
    return safe_cast(o, {"price": "bigint", "large": "bigint"})


def q_bigint_mean(spark, sf_dir):
    """Means over whole numbers whose sum leaves the bigint range."""
    ev = _t(spark, sf_dir, "events").withColumn("big", F.col("user_id").cast("long") + F.lit(4_000_000_000_000_000_000))
    out = windowed_measures(ev, WindowSpec.tumbling("1440 minutes"), "ts", {"n": M.size(), "mean_big": M.mean("big")})
    return out.select("window_start", "window_end", "n", F.round(F.col("mean_big") / 1e15, 6).alias("mean_big"))


def q_rename_tag(spark, sf_dir):
    ev = rename_if_present(_t(spark, sf_dir, "events"), "event_type", "tag")
    return rename_if_present(ev, "no_such_column", "other").select("event_id", "tag")


def q_pack_messages(spark, sf_dir):
    ev = tag_constants(_t(spark, sf_dir, "events").select("event_id", "event_type", "value"), {"num_cores": "8"})
    msgs = to_messages(ev, "winsight")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("num_cores", T.StringType())])
    return decode_json(msgs, schema, keep=["key"])


def q_route_keys(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select("event_id", route_by_key(F.col("event_type").cast("binary"), ["view", "purchase"], "click")
                     .alias("source"))


def q_window_labels(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "click", "tumbling").when(F.col("event_type") == "view", "Sliding")
            .when(F.col("event_type") == "signup", "SESSION").when(F.col("event_type") == "purchase", "tumbling")
            .otherwise("hopping"))
    dur = F.concat((F.hour("ts") + 1).cast("string"), F.lit(" minutes"))
    gap = F.when(F.col("event_type") != "purchase", F.lit("1 minutes"))
    return ev.select("event_id", window_label(kind, dur, F.lit("5 seconds"), gap).alias("label"))


# ---------------------------------------------------------------- batches and run analytics
SIZES = [100, 200, 300]
SOURCES, DEFAULT_SOURCE, MARKER = ["view", "purchase"], "click", "signup"
RUN_CONSTANTS = {"window_setting": "tumbling_1 minutes", "number_of_cores": "8", "number_of_threads": "1",
                 "memory_limit": "8G", "experiment_type": "kafka"}


def q_batches(spark, sf_dir):
    return assign_batches(_t(spark, sf_dir, "events").select("event_id"), "event_id", SIZES) \
        .select("event_id", "batch_id")


def q_batch_markers(spark, sf_dir):
    return batch_markers(assign_batches(_t(spark, sf_dir, "events").select("event_id"), "event_id", SIZES))


def messages_of(ev: DataFrame) -> DataFrame:
    """events as a one-partition result topic: offset = event_id, key = event_type,
    'signup' rows are batch markers; value carries timing / marker fields."""
    ev = ev.withColumn("_ms", _ms("ts"))
    ms = F.col("_ms")
    value = F.to_json(F.struct(
        (ms - F.col("user_id")).alias("time"),
        F.when(F.col("event_type") == "click", F.floor("value")).alias("checkingTimeMs"),
        F.col("event_id").alias("blast_id"), F.col("user_id").alias("blast_size"),
        (ms - 1000).alias("blast_start_time"), F.when(F.col("value") > 10, ms).alias("blast_end_time")))
    return ev.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
                     F.col("event_type").cast("binary").alias("key"), value.alias("value"),
                     F.timestamp_millis(ms).alias("timestamp"))


def event_messages(spark, sf_dir) -> DataFrame:
    return messages_of(_t(spark, sf_dir, "events"))


def q_segments(spark, sf_dir):
    msgs = classify(event_messages(spark, sf_dir), MARKER, SOURCES, DEFAULT_SOURCE)
    return segment_by_marker(msgs).select("offset", "segment")


def q_source_totals(spark, sf_dir):
    msgs = classify(event_messages(spark, sf_dir), MARKER, SOURCES, DEFAULT_SOURCE)
    return source_totals(segment_by_marker(weighted_rows(msgs)))


def q_run_summary(spark, sf_dir):
    return run_summary(event_messages(spark, sf_dir), MARKER, SOURCES, DEFAULT_SOURCE, RUN_CONSTANTS)


def _timings(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    file = (F.when((F.col("event_type") == "signup") & (F.hour("ts") >= 20), "c.csv")
            .when(F.hour("ts") < 12, "a.csv").otherwise("b.csv"))
    return ev.select(F.col("event_type").alias("run"), file.alias("file"), _ms("ts").alias("timestamp"))


def q_run_latest(spark, sf_dir):
    return latest_by_run(_timings(spark, sf_dir))


def q_run_elapsed(spark, sf_dir):
    latest = latest_by_run(_timings(spark, sf_dir))
    # the run start is one global aggregate: a scalar subquery, evaluated once
    start = _t(spark, sf_dir, "events").agg(F.min(_ms("ts"))).scalar()
    return run_elapsed(latest, start, elements=100, sleep=2.0)


def q_run_stats(spark, sf_dir):
    st = run_stats(_with_amount(_t(spark, sf_dir, "events")), "user_id", "amount")
    return st.withColumn("std", F.round("std", 6))


def experiment_frame(spark, sf_dir) -> DataFrame:
    """events replayed in batches of 100, 200, 300 records (B1): ``batch_id`` is the tag."""
    ev = _events_with_gaps(spark, sf_dir)
    return assign_batches(ev, "event_id", SIZES).drop("batch_size")


def q_experiment_suite(spark, sf_dir, window: WindowSpec | None = None):
    """The experiment set-up: comment-style checks per (replay batch, window)."""
    window = window or WindowSpec.parse("sliding", "10 minutes", "1 minutes", "5 seconds")
    return reddit_like_suite().evaluate(experiment_frame(spark, sf_dir), window, "ts", tags=["batch_id"])


def q_union_results(spark, sf_dir):
    ev = _events_with_gaps(spark, sf_dir)
    day = WindowSpec.tumbling("1440 minutes")
    a = window_result(reddit_like_suite().evaluate(ev, HOUR, "ts"), HOUR, {"suite": "reddit_like"})
    b = window_result(products_like_suite().evaluate(ev, day, "ts"), day, {"suite": "products_like"})
    return union_results(a, b).drop("time")  # the time the record was made


_SLIDE_ROWS = """
select event_id, time_bucket(interval 15 minute, ts, timestamp '1970-01-01') - to_minutes(15 * k) ws
from events, range(4) r(k) where ts is not null
"""

SQL_ASSIGN_SLIDING = f"select event_id, ws window_start, ws + interval 1 hour window_end from ({_SLIDE_ROWS}) x"

SQL_DISTINCT_WINDOWS = """
select distinct event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') window_start,
       time_bucket(interval 6 hour, ts, timestamp '1970-01-01') + interval 6 hour window_end
from events where ts is not null
"""

SQL_ROWS_OF_WINDOW = """
select event_id, user_id, value from events
where ts >= timestamp '2024-01-02 00:00:00' and ts < timestamp '2024-01-02 01:00:00' and event_type = 'click'
"""

SQL_COLLECT_ROWS = f"""
select {_HOUR} window_start, {_HOUR} + interval 1 hour window_end, count(*) n_rows, cast(sum(event_id) as bigint) id_sum
from events where ts is not null group by 1, 2
"""

SQL_JSON_DECODE = """
select event_id, cast(json_extract(props, '$.k') as double) k from events
"""

SQL_EPOCH_MS = "select event_id, (epoch_us(ts) // 1000) ms, epoch_ms(epoch_us(ts) // 1000) ts_ms from events"

SQL_EPOCH_S = """
select event_id, epoch_us(ts) // 1000000 s, make_timestamp((epoch_us(ts) // 1000000) * 1000000) ts_s from events
"""

SQL_PARSE_TS = """
select event_id, text, try_strptime(text, '%Y-%m-%d %H:%M:%S.%g') parsed
from (select event_id, case when event_type = 'error' then 'bad' else strftime(ts, '%Y-%m-%d %H:%M:%S.%g') end text
      from events) x
"""

SQL_SAFE_CAST = """
select o_orderkey, o_orderkey key_text, try_cast(trim(o_orderpriority) as bigint) prio,
       try_cast(trim(o_orderstatus) as bigint) status
from orders
"""

SQL_SAFE_CAST_TYPED = """
select o_orderkey, floor(o_totalprice)::bigint price, (o_totalprice > 100000)::bigint large from orders
"""

SQL_BIGINT_MEAN = """
select time_bucket(interval 1 day, ts, timestamp '1970-01-01') window_start,
       time_bucket(interval 1 day, ts, timestamp '1970-01-01') + interval 1 day window_end, count(*) n,
       round((sum(user_id::hugeint + 4000000000000000000)::double / count(user_id)) / 1e15, 6) mean_big
from events where ts is not null group by 1, 2
"""

SQL_RENAME_TAG = "select event_id, event_type tag from events"

SQL_PACK_MESSAGES = "select 'winsight' \"key\", event_id, event_type, value, '8' num_cores from events"

SQL_ROUTE_KEYS = """
select event_id, case when event_type in ('view', 'purchase') then event_type else 'click' end source from events
"""

SQL_WINDOW_LABELS = """
select event_id, case
  when event_type in ('click', 'purchase') then 'tumbling_' || dur
  when event_type = 'view' then 'sliding_' || dur || '_5 seconds'
  when event_type = 'signup' then 'session_' || dur || '_1 minutes' end label
from (select *, cast(hour(ts) + 1 as varchar) || ' minutes' dur from events) x
"""

_BATCHES = """
select event_id, cast(((rn - 1) // 600) * 3 + case when (rn - 1) % 600 < 100 then 1
                                                   when (rn - 1) % 600 < 300 then 2 else 3 end as bigint) batch_id
from (select event_id, row_number() over (order by event_id) rn from events) x
"""

SQL_BATCHES = _BATCHES

SQL_BATCH_MARKERS = f"""
with b as ({_BATCHES}), s as (select batch_id, count(*) n from b group by 1),
z as (select batch_id, n, cast(case (batch_id - 1) % 3 when 0 then 100 when 1 then 200 else 300 end as bigint) batch_size
      from s)
select batch_id, batch_size from z where n = batch_size
"""

_MSGS = """
with e as (select *, cast(coalesce(sum(case when event_type = 'signup' then 1 else 0 end)
                       over (order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) segment,
                  (epoch_us(ts) // 1000) arrival,
                  case when event_type in ('view', 'purchase') then event_type else 'click' end source,
                  coalesce(case when event_type = 'click' then cast(floor(value) as bigint) end, user_id) proc
           from events),
t as (select segment, source, count(*) number_of_windows, coalesce(max(arrival), -1) max_timestamp,
             cast(sum(proc) as bigint) processing_time
      from e where event_type <> 'signup' group by 1, 2)
"""

SQL_SEGMENTS = """
select event_id "offset", cast(coalesce(sum(case when event_type = 'signup' then 1 else 0 end)
       over (order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) segment
from events
"""

SQL_SOURCE_TOTALS = _MSGS + 'select 0 "partition", segment, source, number_of_windows, max_timestamp, processing_time from t'

SQL_RUN_SUMMARY = _MSGS + """,
m as (select segment, event_id blast_id, user_id blast_size, (epoch_us(ts) // 1000) - 1000 blast_start_time,
             case when value > 10 then (epoch_us(ts) // 1000) else -1 end blast_end_time
      from e where event_type = 'signup')
select 0 "partition", m.segment, t.source tool, blast_id, blast_size, blast_start_time, blast_end_time,
       number_of_windows, max_timestamp, processing_time, 'tumbling_1 minutes' window_setting,
       '8' number_of_cores, '1' number_of_threads, '8G' memory_limit, 'kafka' experiment_type
from m join t on m.segment = t.segment where max_timestamp > 0
"""

_LATEST = """
select event_type run, max((epoch_us(ts) // 1000)) latest, count(distinct file) n_files
from (select *, case when event_type = 'signup' and hour(ts) >= 20 then 'c.csv'
                     when hour(ts) < 12 then 'a.csv' else 'b.csv' end file from events) x
group by 1
"""

SQL_RUN_LATEST = _LATEST

SQL_RUN_ELAPSED = f"""
select run, latest, n_files, cast(latest - (select min((epoch_us(ts) // 1000)) from events) - 200.0 as double) elapsed
from ({_LATEST}) l
"""

SQL_RUN_STATS = """
select user_id, count(value) n, cast(sum(cast(value as decimal(12, 2))) as double) / count(value) mean,
       round(stddev_pop(cast(value as decimal(12, 2))), 6) std
from events group by 1
"""

SQL_UNION_RESULTS = f"""
select window_start, window_end, 'tumbling' window_type, '60 minutes' window_duration, batch_size, num_failed,
       'reddit_like' suite from ({SQL_CHECKS_REDDIT}) a
union all
select window_start, window_end, 'tumbling', '1440 minutes', batch_size, num_failed, 'products_like'
from ({_products_sql(None)}) b
"""


SQL_STREAM_TUMBLING = f"select * from ({SQL_TUMBLING}) x where window_end <= (select max(ts) from events)"

SQL_STREAM_TUMBLING_UNIQUE2 = f"""
with w as (select {_HOUR} ws, * from events where ts is not null),
once as ({" union all ".join(f"select ws, '{c}' col, count(*) c from w where {c} is not null group by ws, {c}" for c in ("user_id", "value", "event_type"))}),
u as (select ws, col, count(*) filter (where c = 1) / sum(c) f from once group by 1, 2)
select ws window_start, ws + interval 1 hour window_end, count(*) n, max(value) mx,
       any_value((select f from u where u.ws = w.ws and col = 'user_id')) u_user,
       any_value((select f from u where u.ws = w.ws and col = 'value')) u_value,
       any_value((select f from u where u.ws = w.ws and col = 'event_type')) u_kind
from w group by ws having ws + interval 1 hour <= (select max(ts) from events)
"""

SQL_STREAM_COLLECT_ROWS = f"select * from ({SQL_COLLECT_ROWS}) x where window_end <= (select max(ts) from events)"

SQL_STREAM_DISTINCT_WINDOWS = f"select * from ({SQL_DISTINCT_WINDOWS}) x where window_end <= (select max(ts) from events)"

SQL_STREAM_SESSION = _SESSIONS + """
select * from (select user_id, min(ts) window_start, max(ts) + interval 2 hour window_end, count(*) n,
                      max(value) mx, min(value) mn from b group by user_id, sid) x
where window_end <= (select max(ts) from events)
"""

SQL_STREAM_SESSION_UNIQUE = f"""
select * from ({SQL_SESSION_UNIQUE}) x where window_end <= (select max(ts) from events)
"""

SQL_STREAM_SUMMARY = _MSGS + """,
m as (select segment, event_id "offset", event_id blast_id, user_id blast_size,
             (epoch_us(ts) // 1000) - 1000 blast_start_time,
             case when value > 10 then (epoch_us(ts) // 1000) else -1 end blast_end_time
      from e where event_type = 'signup')
select 0 "partition", "offset", t.source tool, blast_id, blast_size, blast_start_time, blast_end_time,
       number_of_windows, max_timestamp, processing_time, 'tumbling_1 minutes' window_setting,
       '8' number_of_cores, '1' number_of_threads, '8G' memory_limit, 'kafka' experiment_type
from m join t on m.segment = t.segment where max_timestamp > 0
"""

SQL_CSV_ROUNDTRIP = "select event_id, ts, user_id, event_type, value, props from events"

SQL_TIMINGS_CSV = """
select event_type run, max(epoch_us(ts) // 1000) latest, count(*) n from events group by 1
"""

SQL_TEXT_VALUES = """
select event_type run, count(value) n, cast(sum(cast(value as decimal(12, 2))) as double) / count(value) mean,
       round(stddev_pop(cast(value as decimal(12, 2))), 6) std
from events group by 1
"""

SQL_RUN_REPORT = SQL_RUN_ELAPSED

SQL_SUMMARY_CSV = SQL_RUN_SUMMARY


SQL_EXPERIMENT_SUITE = f"""
with b as (select *, cast(((rn - 1) // 600) * 3 + case when (rn - 1) % 600 < 100 then 1
                                                       when (rn - 1) % 600 < 300 then 2 else 3 end as bigint) batch_id
           from (select *, row_number() over (order by event_id) rn from {_GAPS} g) y),
x as (select *, time_bucket(interval 1 minute, ts, timestamp '1970-01-01') - to_minutes(k) ws from b, range(10) r(k)),
p as (select batch_id, ws, user_id, count(*) c, count(kind) nn, min(value) mn, sum(amount) sv, count(amount) nv
      from x group by 1, 2, 3),
w as (select batch_id, ws, cast(sum(c) as bigint) batch_size, sum(nn) / sum(c) id_complete,
             sum(case when user_id is not null and c = 1 then 1 else 0 end)
               / nullif(sum(case when user_id is not null then c else 0 end), 0) id_unique,
             min(mn) min_value, cast(sum(sv) as double) / nullif(sum(nv), 0) mean_value,
             sum(nn) / sum(c) kind_completeness
      from p group by 1, 2),
v as (select *, coalesce(id_complete = 1, false) id_complete_ok, coalesce(id_unique = 1, false) id_unique_ok,
             coalesce(min_value >= 1, false) min_value_ok, coalesce(mean_value < 50, false) mean_value_ok,
             coalesce(kind_completeness > 0.9, false) kind_completeness_ok from w)
select batch_id, ws window_start, ws + interval 10 minute window_end, batch_size, id_complete, id_unique, min_value,
       mean_value, kind_completeness, id_complete_ok, id_unique_ok, min_value_ok, mean_value_ok,
       kind_completeness_ok,
       cast((not id_complete_ok)::int + (not id_unique_ok)::int + (not min_value_ok)::int
            + (not mean_value_ok)::int + (not kind_completeness_ok)::int as bigint) num_failed
from v
"""


# ---------------------------------------------------------------- contract
def _llm():
    """The queries of the training-data subpackage, or None where it is not there."""
    if importlib.util.find_spec("winsight.llm") is None or importlib.util.find_spec("winsight.llm.queries") is None:
        return None
    return importlib.import_module("winsight.llm.queries")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the reddit-style suite over hourly windows of the sf0.001 events."""
    return q_checks_reddit_like(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "tumbling_suite": q_tumbling_suite,
        "sliding_suite": q_sliding_suite,
        "sliding_measures": q_sliding_measures,
        "session_counts": q_session_counts,
        "session_unique": q_session_unique,
        "measures_all": q_measures_all,
        "checks_reddit_like": q_checks_reddit_like,
        "checks_products_like": q_checks_products_like,
        "verdict_rows": q_verdict_rows,
        "tagged_suite": q_tagged_suite,
        "assign_sliding": q_assign_sliding,
        "distinct_windows": q_distinct_windows,
        "rows_of_window": q_rows_of_window,
        "collect_rows": q_collect_rows,
        "json_decode": q_json_decode,
        "epoch_ms": q_epoch_ms,
        "epoch_s": q_epoch_s,
        "parse_ts": q_parse_ts,
        "safe_cast": q_safe_cast,
        "safe_cast_typed": q_safe_cast_typed,
        "bigint_mean": q_bigint_mean,
        "rename_tag": q_rename_tag,
        "pack_messages": q_pack_messages,
        "route_keys": q_route_keys,
        "window_labels": q_window_labels,
        "batches": q_batches,
        "batch_markers": q_batch_markers,
        "segments": q_segments,
        "source_totals": q_source_totals,
        "run_summary": q_run_summary,
        "run_latest": q_run_latest,
        "run_elapsed": q_run_elapsed,
        "run_stats": q_run_stats,
        "union_results": q_union_results,
        "experiment_suite": q_experiment_suite,
        "stream_tumbling": q_stream_tumbling,
        "stream_session": q_stream_session,
        "stream_session_unique": q_stream_session_unique,
        "stream_sliding": q_stream_sliding,
        "stream_batches": q_stream_batches,
        "stream_batch_markers": q_stream_batch_markers,
        "stream_tumbling_unique2": q_stream_tumbling_unique2,
        "stream_collect_rows": q_stream_collect_rows,
        "stream_distinct_windows": q_stream_distinct_windows,
        "stream_summary": q_stream_summary,
        "csv_roundtrip": q_csv_roundtrip,
        "timings_csv": q_timings_csv,
        "text_values": q_text_values,
        "run_report": q_run_report,
        "summary_csv": q_summary_csv,
    }
    llm = _llm()
    return out | llm.queries() if llm else out


def oracle_sql() -> dict[str, str]:
    out = {
        "tumbling_suite": SQL_TUMBLING,
        "sliding_suite": SQL_SLIDING,
        "sliding_measures": SQL_SLIDING_MEASURES,
        "session_counts": SQL_SESSION_COUNTS,
        "session_unique": SQL_SESSION_UNIQUE,
        "measures_all": SQL_MEASURES_ALL,
        "checks_reddit_like": SQL_CHECKS_REDDIT,
        "checks_products_like": SQL_CHECKS_PRODUCTS,
        "verdict_rows": SQL_VERDICT_ROWS,
        "tagged_suite": SQL_TAGGED,
        "assign_sliding": SQL_ASSIGN_SLIDING,
        "distinct_windows": SQL_DISTINCT_WINDOWS,
        "rows_of_window": SQL_ROWS_OF_WINDOW,
        "collect_rows": SQL_COLLECT_ROWS,
        "json_decode": SQL_JSON_DECODE,
        "epoch_ms": SQL_EPOCH_MS,
        "epoch_s": SQL_EPOCH_S,
        "parse_ts": SQL_PARSE_TS,
        "safe_cast": SQL_SAFE_CAST,
        "safe_cast_typed": SQL_SAFE_CAST_TYPED,
        "bigint_mean": SQL_BIGINT_MEAN,
        "rename_tag": SQL_RENAME_TAG,
        "pack_messages": SQL_PACK_MESSAGES,
        "route_keys": SQL_ROUTE_KEYS,
        "window_labels": SQL_WINDOW_LABELS,
        "batches": SQL_BATCHES,
        "batch_markers": SQL_BATCH_MARKERS,
        "segments": SQL_SEGMENTS,
        "source_totals": SQL_SOURCE_TOTALS,
        "run_summary": SQL_RUN_SUMMARY,
        "run_latest": SQL_RUN_LATEST,
        "run_elapsed": SQL_RUN_ELAPSED,
        "run_stats": SQL_RUN_STATS,
        "union_results": SQL_UNION_RESULTS,
        "experiment_suite": SQL_EXPERIMENT_SUITE,
        "stream_tumbling": SQL_STREAM_TUMBLING,
        "stream_session": SQL_STREAM_SESSION,
        "stream_session_unique": SQL_STREAM_SESSION_UNIQUE,
        "stream_sliding": SQL_STREAM_SLIDING,
        "stream_batches": SQL_BATCHES,
        "stream_batch_markers": SQL_BATCH_MARKERS,
        "stream_tumbling_unique2": SQL_STREAM_TUMBLING_UNIQUE2,
        "stream_collect_rows": SQL_STREAM_COLLECT_ROWS,
        "stream_distinct_windows": SQL_STREAM_DISTINCT_WINDOWS,
        "stream_summary": SQL_STREAM_SUMMARY,
        "csv_roundtrip": SQL_CSV_ROUNDTRIP,
        "timings_csv": SQL_TIMINGS_CSV,
        "text_values": SQL_TEXT_VALUES,
        "run_report": SQL_RUN_REPORT,
        "summary_csv": SQL_SUMMARY_CSV,
    }
    llm = _llm()
    return out | llm.oracle_sql() if llm else out
