"""Streams on keyed state: run summaries, sliding windows, batches and markers; several
uniqueness columns, bags of rows, distinct windows, late rows, fan-out to several sinks."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from test_streaming import LINES, _stream, _write_batches
from winsight import WindowSpec, windowed_measures
from winsight.operators import measures as M
from winsight.operators.batches import assign_batches, batch_markers
from winsight.operators.runs import run_summary
from winsight.operators.windows import assign_windows, collect_rows, distinct_windows
from winsight.session import age_in_order, written_files
from winsight.sources.sinks import FanOut, batch_files, each_batch, late_rows
from winsight.streaming.batches import BatchTags, stream_batch_markers
from winsight.streaming.sessions import SessionMeasures
from winsight.streaming.sliding import stream_sliding
from winsight.streaming.state import PROVIDER, run_stateful, start_stateful
from winsight.streaming.suites import run_available
from winsight.streaming.summary import SummaryStream

SF = "/root/testdata/sf0.001"


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = ([tuple(r) for r in df.select(*cols).collect()] for df in (got, want))
    assert sorted(a, key=repr) == sorted(b, key=repr)


def files_in_turn(df, folder, by, n):
    """``df`` as ``n`` Parquet files by the ranges of ``by``, one per micro-batch; returns their paths in turn."""
    os.makedirs(folder, exist_ok=True)
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    out = []
    for i in range(n):
        path = f"{folder}/part-{i:03d}.parquet"
        df.where(F.floor((F.col(by) - lo) * n / (hi - lo + 1)) == i).coalesce(1).write.parquet(f"{path}.d")
        (one,) = [f for f in os.listdir(f"{path}.d") if f.endswith(".parquet")]
        os.rename(f"{path}.d/{one}", path)
        shutil.rmtree(f"{path}.d")
        os.utime(path, (2_000_000 + i, 2_000_000 + i))
        out.append(path)
    return out


def test_summary_continues_after_a_restart(spark, tmp_path):
    """The first query stops with a segment open; the second goes on from the checkpoint."""
    msgs = E.messages_of(spark.read.parquet(f"{SF}/events.parquet")).withColumn("partition", F.when(F.col("offset") % 3 > 0, F.col("offset") % 3))
    first, rest = tmp_path / "first", tmp_path / "in"
    paths = files_in_turn(msgs, str(first), "offset", 5)
    os.makedirs(rest)
    settings = E.MARKER, E.SOURCES, E.DEFAULT_SOURCE, E.RUN_CONSTANTS
    for some in (paths[:2], paths[2:]):
        for p in some:
            os.link(p, rest / os.path.basename(p))
        s = SummaryStream(spark, *settings, base=str(tmp_path / "out"))
        q = s.start(spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(str(rest)), {"availableNow": True})
        q.awaitTermination()
        assert q.exception() is None and len(q.recentProgress) >= len(some)
    assert spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)
    same(s.result().drop("offset"), run_summary(msgs, *settings).drop("segment"))


def test_summary_of_messages_without_markers_sources_and_offsets(spark, tmp_path):
    rows = [(0, 1, "a", '{"checkingTimeMs": 5}', 10), (0, 2, None, "not json", 20), (1, 7, "m", '{"blast_id": 3}', 30),
            (0, 9, "m", '{"blast_id": 4}', 40), (0, 10, "a", '{"time": 1}', 50), (None, 1, "a", "{}", 60), (None, 2, "m", "{}", 70)]
    df = spark.createDataFrame(rows, "partition int, offset long, key string, value string, ms long").withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = SummaryStream(spark, "m", ["a"], "b")
    s.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), {"availableNow": True}).awaitTermination()
    same(s.result().drop("offset"), run_summary(df, "m", ["a"], "b").drop("segment"))


# ------------------------------------------------------------- sliding
def test_sliding_late_rows_as_with_spark(spark, tmp_path):
    """G3's late rows: a row counts for the windows that are open, and only for those."""
    _write_batches(str(tmp_path / "in"), LINES)
    ms = {"n": M.size(), "mx": M.max("v"), "mn": M.min("id"), "mean": M.mean("v"), "nn": M.count("v"), "c": M.completeness("v")}
    for spec in (WindowSpec.sliding("10 seconds", "5 seconds"), WindowSpec.sliding("10 seconds", "4 seconds"), WindowSpec.sliding("6 seconds", "6 seconds")):
        got = run_stateful(stream_sliding(_stream(spark, str(tmp_path / "in")), spec, "ts", ms), "late", 2)
        same(got, run_available(spark, windowed_measures(_stream(spark, str(tmp_path / "in")), spec, "ts", ms), "late2"))


def test_sliding_with_tags_and_rows_out_of_order(spark, tmp_path):
    r = random.Random(4)
    lines = [[(max(0, 40 * i + r.randint(-60, 40)), r.choice(["a", "b", None]), r.choice([None, 1, 2 ** 62])) for _ in range(40)] for i in range(6)]
    _write_batches(str(tmp_path / "in"), lines)
    ms = {"n": M.size(), "mean": M.mean("v"), "mx": M.max("v"), "frac": M.fraction_of_set_conformance("v", [1])}
    spec = WindowSpec.sliding("30 seconds", "10 seconds")
    got = run_stateful(stream_sliding(_stream(spark, str(tmp_path / "in")), spec, "ts", ms, ["id"], watermark="20 seconds"), "tags", 2)
    want = windowed_measures(_stream(spark, str(tmp_path / "in")), spec, "ts", ms, ["id"], watermark="20 seconds")
    same(got, run_available(spark, want, "tags2"))


def test_sliding_rows_enter_the_state_once_and_leave_it(spark, tmp_path):
    """State: a pane per ``gcd``, not a window per row; gone once the windows have closed."""
    lines = [[(s, "a", 1) for s in range(100) for _ in range(50)], [(10_000, "a", 1)], [(20_000, "a", 1)]]
    _write_batches(str(tmp_path / "in"), lines)
    out = stream_sliding(_stream(spark, str(tmp_path / "in")), WindowSpec.sliding("100 seconds", "10 seconds"), "ts", {"n": M.size()})
    q = start_stateful(out, str(tmp_path / "out"), str(tmp_path / "chk"), {"availableNow": True}, 1)
    q.awaitTermination()
    assert q.exception() is None
    first, *_, last = [p["stateOperators"][0] for p in q.recentProgress]
    assert first["numRowsUpdated"] <= 60  # 10 panes, 19 ends and a timer for 5,000 rows
    assert last["numRowsTotal"] <= 30  # one pane and its open ends are left
    with pytest.raises(ValueError):
        stream_sliding(_stream(spark, str(tmp_path / "in")), WindowSpec.sliding("10 seconds", "5 seconds"), "ts", {"u": M.fraction_of_unique("id")})
    with pytest.raises(ValueError):
        stream_sliding(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts", {"n": M.size()})


# ------------------------------------------------------------- batches
@pytest.mark.parametrize("parts", [[], ["p"]])
def test_batches_and_markers_of_a_stream(spark, tmp_path, parts):
    ev = spark.range(1, 701).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("p"))
    files_in_turn(ev, str(tmp_path / "in"), "id", 4)
    stream = lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tags = BatchTags(spark, "id", [7, 20, 1], parts)
    q = tags.start(stream(), {"availableNow": True})
    q.awaitTermination()
    assert len(q.recentProgress) > 1
    want = assign_batches(ev, "id", [7, 20, 1], parts)
    same(tags.result(), want)
    got = run_stateful(stream_batch_markers(stream(), [7, 20, 1], parts), "markers", 2)
    same(got, batch_markers(want, parts))


def test_batch_numbers_of_a_repeated_micro_batch(spark):
    """A micro-batch that runs again starts from the same counts and overwrites its rows."""
    tags = BatchTags(spark, "id", [3])
    tags.process(spark.range(0, 5), 0)
    for _ in range(2):
        tags.process(spark.range(5, 10), 1)
    tags.process(spark.range(10, 12), 2)
    assert [r.batch_id for r in tags.result().orderBy("id").collect()] == [1 + i // 3 for i in range(12)]


# ------------------------------------------- windows over streams: values, bags, keys
def test_several_unique_columns(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), LINES)
    ms = {"n": M.size(), "mx": M.max("v"), "u1": M.fraction_of_unique("id"), "u2": M.fraction_of_unique("v"), "u3": M.fraction_of_unique("sec")}
    for spec in (WindowSpec.tumbling("10 seconds"), WindowSpec.sliding("10 seconds", "5 seconds")):
        got = run_available(spark, windowed_measures(_stream(spark, str(tmp_path / "in")), spec, "ts", ms), "u3")
        alone = [run_available(spark, windowed_measures(_stream(spark, str(tmp_path / "in")), spec, "ts", {k: ms[k] for k in ("n", "mx", u)}), u)
                 for u in ("u1", "u2", "u3")]
        want = alone[0].join(alone[1].drop("n", "mx"), ["window_start", "window_end"]).join(alone[2].drop("n", "mx"), ["window_start", "window_end"])
        same(got, want)


def test_collect_rows_on_a_stream(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), LINES)
    out = collect_rows(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts", chunk_rows=5, chunk_by="sec")
    got = run_available(spark, out, "bags")
    bags = {(r.s, r.chunk): sorted(x.id for x in r.rows) for r in got.select(F.unix_seconds("window_start").alias("s"), "chunk", "rows").collect()}
    assert bags == {(0, 0): ["a", "z"], (0, 1): ["a", "b"], (10, 2): ["c", "late2"], (30, 6): ["q", "r"]}
    with pytest.raises(ValueError):
        collect_rows(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts")


def test_distinct_windows_forgets(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), [*LINES, [(1000, "x", 1)], [(2000, "x", 1)]])
    w = assign_windows(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts", watermark="0 seconds")
    q = start_stateful(distinct_windows(w, ["id"]), str(tmp_path / "out"), str(tmp_path / "chk"), {"availableNow": True})
    q.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(totals) > 1 and totals[-1] == 1  # the last window is open
    got = {(r.id, r.s) for r in spark.read.parquet(str(tmp_path / "out")).select("id", F.unix_seconds("window_start").alias("s")).collect()}
    assert got == {("a", 0), ("b", 0), ("z", 0), ("c", 10), ("late2", 10), ("q", 30), ("r", 30), ("end", 100), ("x", 1000)}


# ------------------------------------------------------------- late rows, sinks
def test_late_rows_are_counted(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), LINES)
    out = windowed_measures(_stream(spark, str(tmp_path / "in")), WindowSpec.tumbling("10 seconds"), "ts", {"n": M.size()})
    q = start_stateful(out, str(tmp_path / "out"), str(tmp_path / "chk"), {"availableNow": True})
    q.awaitTermination()
    assert {k: v for k, v in late_rows(q.recentProgress).items() if v} == {3: 1}  # G2: "late"
    proc = SessionMeasures(spark, WindowSpec.session("5 seconds"), "ts", {"n": M.size(), "u": M.fraction_of_unique("id")})
    proc.start(_stream(spark, str(tmp_path / "in")), {"availableNow": True}).awaitTermination()
    assert {k: v for k, v in proc.late.items() if v} == {2: 1, 3: 2}  # z; late and late2


def test_large_numbers_in_streamed_sessions(spark, tmp_path):
    _write_batches(str(tmp_path / "in"), [[(0, "a", 2 ** 62), (1, "b", 2 ** 62), (2, "c", 2 ** 62)], [(100, "end", 0)]])
    proc = SessionMeasures(spark, WindowSpec.session("5 seconds"), "ts", {"mean": M.mean("v"), "u": M.fraction_of_unique("id")})
    q = proc.start(_stream(spark, str(tmp_path / "in")), {"availableNow": True})
    q.awaitTermination()
    assert [r.mean for r in proc.result().collect()] == [float(2 ** 62)]


def test_fan_out_repeats_only_what_failed(spark, tmp_path):
    """The second sink fails once; in the end each has every row once."""
    _write_batches(str(tmp_path / "in"), LINES[:3])
    calls, broken = [], [True]

    def appends(batch, batch_id):  # not repeatable: it must not run twice for a micro-batch
        calls.append(batch_id)
        batch.write.mode("append").parquet(str(tmp_path / "first"))

    def fails_once(batch, batch_id):
        if batch_id == 1 and broken.pop() if broken else False:
            raise RuntimeError("sink is down")
        batch_files(str(tmp_path / "second"))(batch, batch_id)

    fan = FanOut({"first": appends, "second": fails_once}, str(tmp_path / "ledger"))
    for _ in range(2):
        q = each_batch(_stream(spark, str(tmp_path / "in")), fan, str(tmp_path / "chk"), trigger={"availableNow": True})
        try:
            q.awaitTermination()
        except Exception as e:
            assert "sink is down" in str(e)
    assert calls == [0, 1, 2]
    for name in ("first", "second"):
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == sorted(i for line in LINES[:3] for _, i, _ in line)
    with pytest.raises(ValueError):
        FanOut({}, str(tmp_path / "ledger"))


def _events(spark, folder, rows):
    """An ``events`` table of ``(event_id, seconds, user_id)`` rows."""
    from pyspark.sql import functions as F
    (spark.createDataFrame(rows, "event_id long, s long, user_id long")
     .select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id",
             F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
     .write.parquet(f"{folder}/events.parquet"))


def test_ordered_stream_is_cut_evenly_into_few_micro_batches(spark, tmp_path, monkeypatch):
    """An outlier and many rows: even files in order, every row once; the files do not grow in number with each ``STREAM_ROWS``."""
    import __spark_entry__ as e
    from pyspark.sql import functions as F
    monkeypatch.setattr(e, "STREAM_ROWS", 10)
    _events(spark, str(tmp_path), [(i if i < 399 else 10 ** 9, i, i % 7) for i in range(400)])
    seen = {}

    def note(batch, i):
        seen[i] = [r[0] for r in batch.select("event_id").collect()]

    stream = e.ordered_stream(spark, str(tmp_path), F.col("event_id"))
    stream.writeStream.foreachBatch(note).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert len(seen) == 8 and max(len(x) for x in seen.values()) <= 100
    assert [x for i in sorted(seen) for x in sorted(seen[i])] == [*range(399), 10 ** 9]


def test_ordered_stream_files_of_many_and_no_rows(spark, tmp_path):
    import __spark_entry__ as e
    assert [e.stream_files(n) for n in (0, 100_000, 150_000, 600_000, 6_000_000, 36_000_000)] == [4, 4, 6, 8, 8, 36]
    _events(spark, str(tmp_path), [])
    assert e.q_stream_batches(spark, str(tmp_path)).count() == 0


def test_small_state_of_sessions_stays_in_few_files(spark, tmp_path):
    """What a small micro-batch leaves behind does not have a file per shuffle partition."""
    import glob

    from pyspark.sql import functions as F
    from winsight.streaming.sessions import SessionMeasures
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 10).cast("timestamp_ntz").alias("ts"), (F.col("id") % 200).alias("k"))
    proc = SessionMeasures(spark, WindowSpec.session("5 seconds"), "ts", {"n": M.size(), "u": M.fraction_of_unique("k")}, ["k"], base=str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        proc.process(rows, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert proc.result().count() == 399  # the last is still open
    assert len(glob.glob(str(tmp_path / "out" / "batch_id=0" / "*.parquet"))) <= 8
    assert not glob.glob(str(tmp_path / "level" / "batch_id=0"))


def test_groups_are_merged_over_the_batches_of_a_task(spark, monkeypatch):
    """A task hands over each key once; with more keys than it may hold, what is merged goes on early."""
    from winsight.streaming import state
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(0, 1000, 1, 1).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("s"), F.col("id").alias("m"))
        want = sorted((k, sum(range(k, 1000, 7)) if k else None, max(range(k, 1000, 7))) for k in range(7))
        assert sorted(map(tuple, state.combined(rows, ["k"], {"s": "sum", "m": "max"}).collect())) == want
        monkeypatch.setattr(state, "HELD_GROUPS", 5)
        got = state.combined(rows, ["k"], {"s": "sum", "m": "max"})
        assert got.count() > 7
        assert sorted(map(tuple, got.groupBy("k").agg(F.sum("s"), F.max("m")).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ordered_stream_files_are_in_order(spark, tmp_path):
    _events(spark, str(tmp_path), [(i * 7 % 401, i, i % 7) for i in range(401)])
    seen = []
    stream = E.ordered_stream(spark, str(tmp_path), F.col("event_id"))
    stream.writeStream.foreachBatch(lambda b, i: seen.extend(r[0] for r in b.coalesce(1).select("event_id").collect())).trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert seen == list(range(401))


def _in_turn(spark, folder, checkpoint):
    """Event ids by micro-batch of the ordered stream, and the jobs that built its input."""
    sc, group = spark.sparkContext, f"ordered {checkpoint}"
    sc.setJobGroup(group, "build")
    try:
        stream = E.ordered_stream(spark, folder, F.col("event_id"))
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append([r[0] for r in b.coalesce(1).select("event_id").collect()]))
    q.trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return seen, jobs


def test_ordered_stream_is_written_in_one_job(spark, tmp_path, monkeypatch):
    """More files take no more jobs, and are still taken in the order of their rows."""
    _events(spark, str(tmp_path), [(i * 7 % 401, i, i % 7) for i in range(401)])
    jobs = set()
    for files in (4, 23):
        monkeypatch.setattr(E, "STREAM_FILES", (files, files))
        seen, n = _in_turn(spark, str(tmp_path), str(tmp_path / f"c{files}"))
        assert len(seen) == files and sum(seen, []) == list(range(401))
        jobs.add(n)
    assert len(jobs) == 1 and jobs != {0}


def test_ordered_stream_where_no_times_can_be_set(spark, tmp_path, monkeypatch):
    _events(spark, str(tmp_path), [(i * 7 % 401, i, i % 7) for i in range(401)])
    monkeypatch.setattr(E, "age_in_order", lambda spark, files: False)
    seen, _ = _in_turn(spark, str(tmp_path), str(tmp_path / "c"))
    assert len(seen) == 4 and sum(seen, []) == list(range(401))


def test_ordered_stream_of_repeated_ids_and_ids_left_out(spark, tmp_path):
    """Rows of equal place share a micro-batch, also with fewer places than files; rows without one are left out."""
    _events(spark, str(tmp_path), [(i % 2 if i % 3 else None, i, 1) for i in range(300)])
    seen, _ = _in_turn(spark, str(tmp_path), str(tmp_path / "c"))
    assert [x for x in seen if x] == [[0] * 100, [1] * 100]


def test_ages_are_in_the_order_of_the_files(spark, tmp_path):
    paths = []
    for i in (2, 0, 1):
        paths.append(str(tmp_path / f"part-{i}"))
        (tmp_path / f"part-{i}").write_text("x")
    (tmp_path / "_SUCCESS").write_text("")
    got = written_files(spark, str(tmp_path))
    assert [os.path.basename(p) for p in got] == ["part-0", "part-1", "part-2"]
    assert age_in_order(spark, got)
    ages = [os.stat(tmp_path / f"part-{i}").st_mtime for i in range(3)]
    assert [b - a for a, b in zip(ages, ages[1:])] == [1, 1]
    assert not age_in_order(spark, [str(tmp_path / "none")])


def _messages(spark):
    """Two partitions and one without a name: gaps, repeated rows, results without time, offset or arrival."""
    r, rows = random.Random(8), []
    for part in (0, 1, None):
        for at in range(600):
            if r.random() < 0.02:
                continue
            key = "m" if r.random() < 0.2 else r.choice(["a", "b", None])
            value = f'{{"blast_id": {at}, "blast_size": 3}}' if key == "m" else r.choice(['{"checkingTimeMs": 5}', '{"time": 1}', "not json"])
            rows += [(part, at, key, value, r.choice([None, at * 10, at * 10, -5]))] * (2 if r.random() < 0.02 else 1)
    return spark.createDataFrame(rows, "partition int, offset long, key string, value string, ms long").withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")


def test_summary_of_whole_segments_equals_the_batch(spark, tmp_path):
    msgs = _messages(spark).persist()
    files_in_turn(msgs.sort("offset"), str(tmp_path / "in"), "offset", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        s = SummaryStream(spark, "m", ["a"], "b")
        s.start(spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), {"availableNow": True}).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = run_summary(msgs, "m", ["a"], "b").drop("segment")
    assert want.count() > 300
    same(s.result().drop("offset"), want)


def test_state_of_the_summary_gets_few_rows(spark):
    """Segments between two markers pass in lanes above 0; the state gets the ends of a stretch of offsets."""
    import pyarrow as pa
    from winsight.streaming.summary import _MARKER, _runs
    n = 1000
    offsets = list(range(500)) + list(range(600, 1100))  # one gap
    cols = {"part0": ["=0"] * n, "lane": pa.array([0] * n, pa.int32()), "is_marker": [i % 10 == 9 for i in range(n)], "source": ["ab"[i % 2] for i in range(n)],
            "offset": offsets, "weight": [1] * n, "arrival": offsets, "proc": [2] * n, **{c: pa.array([i if i % 10 == 9 else None for i in range(n)], pa.int64()) for c in _MARKER}}
    (batch,) = pa.table(cols).to_batches()
    got = pa.Table.from_batches(list(_runs(["part0"])([batch]))).to_pandas()
    state, whole = got[got.lane == 0], got[got.lane > 0]
    assert len(state) == 6 and len(whole) == 98 * 2  # of each stretch: first marker and the results before it
    assert whole.weight.sum() + state.weight[~state.is_marker].sum() == 900 and not whole.is_marker.any()
    assert (whole.proc == 2 * whole.weight).all() and whole.groupby("source").weight.sum().tolist() == [490, 392]
    assert set(whole.lane) <= set(range(1, 17)) and len(set(whole.lane)) > 4
