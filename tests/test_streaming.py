"""Streaming semantics: late rows (G2, G3), stream = batch minus open windows (G13),
and the run summary across micro-batches (A4)."""

import json
import os

from pyspark.sql import functions as F

from winsight import WindowSpec, windowed_measures
from winsight.operators import measures as M
from winsight.streaming.suites import run_available

LINES = [
    [(0, "a", 1), (5, "b", 2)],
    [(9, "a", 3), (14, "c", None)],
    [(3, "z", 9), (31, "q", 4)],
    [(2, "late", 9), (12, "late2", 1), (32, "r", 4)],
    [(100, "end", 0)],
]
SCHEMA = "sec long, id string, v long"


def _write_batches(folder, lines):
    os.makedirs(folder, exist_ok=True)
    for i, line in enumerate(lines):
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            for sec, ident, v in line:
                fh.write(json.dumps({"sec": sec, "id": ident, "v": v}) + "\n")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))


def _stream(spark, folder):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    return src.withColumn("ts", F.timestamp_seconds("sec"))


MEASURES = {"n": M.size(), "mx": M.max("v"), "uniq": M.fraction_of_unique("id")}


def test_g2_late_rows_tumbling(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), LINES)
    out = run_available(spark, windowed_measures(_stream(spark, str(tmp_path / "in")),
                                                 WindowSpec.tumbling("10 seconds"), "ts", MEASURES), "g2")
    base = out.select(F.unix_seconds("window_start").alias("s"), "n", "mx", "uniq").orderBy("s").collect()
    assert [(r.s, r.n, r.mx, r.uniq) for r in base] == [(0, 4, 9, 0.5), (10, 2, 1, 1.0), (30, 2, 4, 1.0)]


def test_g3_late_rows_sliding(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), LINES)
    ms = {"n": M.size(), "uniq": M.fraction_of_unique("id")}
    out = run_available(spark, windowed_measures(_stream(spark, str(tmp_path / "in")),
                                                 WindowSpec.sliding("10 seconds", "5 seconds"), "ts", ms), "g3")
    rows = out.select(F.unix_seconds("window_start").alias("s"), "n", "uniq").orderBy("s").collect()
    assert [(r.s, r.n, r.uniq) for r in rows] == [(-5, 1, 1.0), (0, 4, 0.5), (5, 4, 1.0), (10, 2, 1.0),
                                                   (25, 2, 1.0), (30, 2, 1.0)]


def test_g13_stream_equals_batch_minus_open(spark):
    from winsight.sources.messages import stream_table
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ms = {"n": M.size(), "mx": M.max("value"), "uniq": M.fraction_of_unique("user_id")}
    spec = WindowSpec.tumbling("60 minutes")
    batch = windowed_measures(ev, spec, "ts", ms)
    stream = run_available(spark, windowed_measures(stream_table(spark, sf, "events"), spec, "ts", ms), "g13")
    assert batch.count() == 531 and stream.count() == 530
    assert stream.exceptAll(batch).count() == 0
    missing = batch.exceptAll(stream).collect()
    assert len(missing) == 1 and str(missing[0].window_start) == "2024-01-30 23:00:00"


def test_stream_session_uniqueness_is_rejected(spark):
    import pytest
    from winsight.sources.messages import stream_table
    src = stream_table(spark, "/root/testdata/sf0.001", "events")
    with pytest.raises(NotImplementedError):
        windowed_measures(src, WindowSpec.session("10 minutes"), "ts", {"u": M.fraction_of_unique("user_id")})


def test_summary_stream_keeps_open_segment(spark, tmp_path):
    """Messages split over several micro-batches give the same summary as one batch run."""
    import __spark_entry__ as E
    from winsight.operators.runs import run_summary
    from winsight.streaming.summary import SummaryStream
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    msgs = E.messages_of(ev)
    folder = str(tmp_path / "msgs")
    # five files by offset range, each one micro-batch
    msgs = msgs.withColumn("part", F.floor(F.col("offset") / 200))
    msgs.write.partitionBy("part").parquet(folder)
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))
    flat = str(tmp_path / "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(files, key=lambda p: int(p.split("part=")[1].split("/")[0]))):
        dst = os.path.join(flat, f"m-{i:03d}.parquet")
        with open(f, "rb") as a, open(dst, "wb") as b:
            b.write(a.read())
        os.utime(dst, (2_000_000 + i, 2_000_000 + i))
    schema = msgs.drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)
    s = SummaryStream(spark, E.MARKER, E.SOURCES, E.DEFAULT_SOURCE, E.RUN_CONSTANTS)
    q = s.start(stream, trigger={"availableNow": True})
    q.awaitTermination()
    got = s.result()
    assert len(q.recentProgress) > 1
    want = run_summary(E.messages_of(ev), E.MARKER, E.SOURCES, E.DEFAULT_SOURCE, E.RUN_CONSTANTS)
    cols = [c for c in want.columns if c != "segment"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_results_with_batch_ids(spark, tmp_path):
    from winsight.streaming.suites import start_with_batch_ids
    _write_batches(str(tmp_path / "in"), LINES)
    res = windowed_measures(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts",
                            {"n": M.size()})
    q = start_with_batch_ids(res, str(tmp_path / "out"), str(tmp_path / "chk"), trigger={"availableNow": True})
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = out.select(F.unix_seconds("window_start").alias("s"), "n", "batch_id").orderBy("s").collect()
    assert [(r.s, r.n) for r in rows] == [(0, 4), (10, 2), (30, 2)]
    assert [r.batch_id for r in rows] == sorted(r.batch_id for r in rows) and rows[0].batch_id >= 1


def _events_by_day(spark, folder):
    """sf0.001 events as one JSON file per day, in event-time order (one micro-batch each)."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    os.makedirs(folder, exist_ok=True)
    rows = ev.orderBy("event_id").collect()
    days = {}
    for r in rows:
        days.setdefault(r.ts.date(), []).append(r)
    for i, day in enumerate(sorted(days)):
        path = os.path.join(folder, f"day-{i:03d}.json")
        with open(path, "w") as fh:
            for r in days[day]:
                fh.write(json.dumps({"event_id": r.event_id, "ts": r.ts.isoformat(), "user_id": r.user_id,
                                     "event_type": r.event_type, "value": r.value}) + "\n")
        os.utime(path, (3_000_000 + i, 3_000_000 + i))
    return ev


def test_stream_session_uniqueness_matches_batch(spark, tmp_path):
    from winsight.streaming.sessions import SessionMeasures
    ev = _events_by_day(spark, str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    ms = {"n": M.size(), "u": M.fraction_of_unique("event_type"), "mx": M.max("value")}
    spec = WindowSpec.session("120 minutes")
    proc = SessionMeasures(spark, spec, "ts", ms, ["user_id"])
    q = proc.start(stream, trigger={"availableNow": True})
    q.awaitTermination()
    got = proc.result()
    assert got.select("batch_id").distinct().count() > 1
    got = got.drop("batch_id")
    max_ts = ev.agg(F.max("ts")).first()[0]
    want = windowed_measures(ev, spec, "ts", ms, tags=["user_id"]).where(F.col("window_end") <= F.lit(max_ts))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_suite_stream_sessions(spark, tmp_path):
    from winsight import Suite
    ev = _events_by_day(spark, str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
    suite = Suite("s").is_unique("event_type").has_max("value", lambda v: v < 90)
    proc = suite.stream_sessions(spark, WindowSpec.session("30 minutes"), "ts", ["user_id"])
    q = proc.start(stream, trigger={"availableNow": True})
    q.awaitTermination()
    got = proc.result().drop("batch_id")
    max_ts = ev.agg(F.max("ts")).first()[0]
    want = suite.evaluate(ev, WindowSpec.session("30 minutes"), "ts", ["user_id"]) \
        .where(F.col("window_end") <= F.lit(max_ts))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_sessions_late_rows(spark, tmp_path):
    """G2's micro-batches through SessionMeasures, gap 5 s (worked by hand):
    [0, 19) closes in batch 3 with a, b, a, c; z(3) is late in batch 3 and
    late(2), late2(12) in batch 4; [31, 37) closes once 100 arrives; [100, 105) stays open."""
    from winsight.streaming.sessions import SessionMeasures
    _write_batches(str(tmp_path / "in"), LINES)
    proc = SessionMeasures(spark, WindowSpec.session("5 seconds"), "ts",
                           {"n": M.size(), "uniq": M.fraction_of_unique("id"), "mx": M.max("v")})
    q = proc.start(_stream(spark, str(tmp_path / "in")), trigger={"availableNow": True})
    q.awaitTermination()
    rows = proc.result().select(F.unix_seconds("window_start").alias("s"), F.unix_seconds("window_end").alias("e"),
                                "n", "uniq", "mx", "batch_id").orderBy("s").collect()
    assert [(r.s, r.e, r.n, r.uniq, r.mx) for r in rows] == [(0, 19, 4, 0.5, 3), (31, 37, 2, 1.0, 4)]
    assert [r.batch_id for r in rows] == [2, 4]
