"""The ready-made product / comment definitions, end to end from message text."""

import json
import os

import pytest

from pyspark.sql import functions as F

from winsight import WindowSpec
from winsight.checks import comment_checks, comment_measures, prepare_comments, prepare_products, product_checks
from winsight.monitor import Monitor


def _messages(spark, records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "value string")


def test_products_from_messages(spark):
    recs = [{"id_": "a", "priority": "high", "numViews": 5, "eventTime": 1_000},
            {"id_": "b", "priority": "normal", "numViews": 89, "eventTime": 2_000},
            {"id_": "c", "priority": None, "numViews": None, "eventTime": 3_000}]
    df = prepare_products(_messages(spark, recs))
    assert dict(df.dtypes)["eventTime"] == "timestamp"
    r = product_checks().evaluate(df, WindowSpec.tumbling("10 seconds"), "eventTime").collect()[0]
    assert r.num_failed == 1 and r.batch_size == 3


def test_comments_by_batch_tag(spark):
    rows = [("a", 0, 0, "x"), ("b", 0, 0, None), ("b", 1, 1, "y"), (None, -1, 0, "z")]
    recs = [{"id_": i, "downs": d, "controversiality": c, "author": a, "created_utc": 60 + k, "blast_id": 1}
            for k, (i, d, c, a) in enumerate(rows)]
    recs += [{"id_": "q", "downs": 0, "controversiality": 0, "author": "w", "created_utc": 61, "blast_id": 2}]
    df = prepare_comments(_messages(spark, recs))
    out = comment_checks().evaluate(df, WindowSpec.tumbling("1 minutes"), "created_utc", ["blast_id"])
    got = {r.blast_id: r.num_failed for r in out.collect()}
    assert got == {"1": 5, "2": 0}
    sess = comment_checks().evaluate(df, WindowSpec.session("5 seconds"), "created_utc", ["blast_id"])
    assert {r.blast_id: r.num_failed for r in sess.collect()} == {"1": 5, "2": 0}


def test_comment_monitor_measures(spark):
    recs = [{"id_": "a", "downs": 2, "controversiality": 1, "author": "x", "created_utc": 5},
            {"id_": "a", "downs": 0, "controversiality": 0, "author": None, "created_utc": 6}]
    mon = Monitor(WindowSpec.tumbling("10 seconds"), "created_utc", source=prepare_comments(_messages(spark, recs)))
    for name, m in comment_measures().items():
        mon.add(m, name)
    r = mon.run().collect()[0]
    assert (r["count"], r.is_id_unique, r.non_negative_downs, r.mean_controversiality, r.author_completeness) \
        == (2, 0.0, 0, 0.5, 1)


def test_monitor_epoch_seconds_and_hidden_bounds(spark):
    df = spark.createDataFrame([(5, "a"), (15, "b")], "t long, id_ string")
    mon = Monitor(WindowSpec.tumbling("10 seconds"), "t", time_unit="s", show_window_end=False, source=df) \
        .add(comment_measures()["count"], "count")
    out = mon.run()
    assert "window_end" not in out.columns and sorted(r["count"] for r in out.collect()) == [1, 1]


def test_quality_job_on_file_stream(spark, tmp_path):
    import importlib.util
    spec = importlib.util.spec_from_file_location("quality_job", os.path.join(
        os.path.dirname(os.path.dirname(__file__)), "jobs", "quality_job.py"))
    job = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(job)
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"id_": f"id{k % 3}", "downs": k % 2, "controversiality": 0, "author": "u", "created_utc": 10 * k,
              "blast_id": 1 + k // 6} for k in range(12)]
    (src / "m.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    env = {"WINDOW_TYPE": "tumbling", "WINDOW_DURATION": "1 minutes", "RECORDS": "comments",
           "SOURCE_FORMAT": "text", "SOURCE_PATH": str(src)}
    out = job.build(spark, env)
    assert out.isStreaming
    from winsight.streaming.suites import run_available
    res = run_available(spark, out, "job_test")
    assert set(res.columns) >= {"blast_id", "window_start", "num_failed", "batch_size", "time", "numCores"}
    # windows [0, 60) and [60, 120) hold 6 records each; the second is still open when the data ends
    rows = [(r.blast_id, r.window_start.timestamp() if r.window_start.tzinfo else r.window_start, r.batch_size, r.num_failed) for r in res.collect()]
    assert [(b, n, f) for b, _, n, f in rows] == [("1", 6, 1)]  # ids repeat: one failed check
    assert all(r.time > 1_600_000_000_000 for r in res.collect())


def test_quality_job_sessions(spark, tmp_path):
    import importlib.util
    spec = importlib.util.spec_from_file_location("quality_job", os.path.join(
        os.path.dirname(os.path.dirname(__file__)), "jobs", "quality_job.py"))
    job = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(job)
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"id_": f"id{k % 4}", "downs": 0, "controversiality": 0, "author": "u", "created_utc": t,
              "blast_id": 1} for k, t in enumerate([0, 2, 4, 30, 31, 100])]
    (src / "m.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    env = {"WINDOW_TYPE": "session", "GAP_DURATION": "5 seconds", "RECORDS": "comments",
           "SOURCE_FORMAT": "text", "SOURCE_PATH": str(src), "OUTPUT_PATH": str(tmp_path / "out"), "OUTPUT_FORMAT": "json",
           "CHECKPOINT": str(tmp_path / "chk")}
    for missing in ("OUTPUT_PATH", "CHECKPOINT"):
        with pytest.raises(ValueError, match=missing):
            job.build(spark, {k: v for k, v in env.items() if k != missing})
    job.start(spark, env, trigger={"availableNow": True}).awaitTermination()
    read = lambda: sorted((r.batch_size, r.num_failed) for r in spark.read.json(str(tmp_path / "out")).collect())
    rows = read()
    assert (tmp_path / "chk" / "checkpoint").exists()
    # a restart goes on where the job stopped: nothing is appended twice
    job.start(spark, env, trigger={"availableNow": True}).awaitTermination()
    assert read() == rows
    # sessions [0, 9) with ids 0,1,2 and [30, 36) with ids 3,0; [100, 105) is still open
    assert rows == [(2, 0), (3, 0)]


def test_clean_comment_records_from_csv(spark, tmp_path):
    from pyspark.sql import types as T
    from winsight.checks import clean_comment_records
    from winsight.sources.files import read_records_csv
    (tmp_path / "c.csv").write_text('id,author,downs,gilded,created_utc,body\n'
                                    'a1,x, 3 ,0,1430438400,"two\nlines"\n'
                                    'a2,,x,,1430438401,\n')
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ("id", "author", "downs", "gilded", "created_utc", "body")])
    df = clean_comment_records(read_records_csv(spark, str(tmp_path / "c.csv"), schema))
    rows = df.orderBy("id_").collect()
    assert "id" not in df.columns and dict(df.dtypes)["downs"] == "bigint"
    assert [(r.id_, r.author, r.downs, r.gilded, r.created_utc) for r in rows] == [
        ("a1", "x", 3, 0, 1430438400), ("a2", "", None, None, 1430438401)]
    assert rows[0].body == "two\nlines"


def test_monitor_text_time_with_strftime_format(spark):
    from winsight.functions.time import spark_pattern
    assert spark_pattern("%Y-%m-%d %H:%M:%S.%f") == "yyyy-MM-dd HH:mm:ss.SSSSSS"
    assert spark_pattern("yyyy-MM-dd") == "yyyy-MM-dd"
    df = spark.createDataFrame([("2024-01-01 00:00:01.250000", "a"), ("2024-01-01 00:00:09.000000", "a"),
                                ("garbage", "b")], "t string, id_ string")
    mon = Monitor(WindowSpec.tumbling("10 seconds"), "t", time_format="%Y-%m-%d %H:%M:%S.%f", source=df) \
        .add(comment_measures()["count"], "count").add(comment_measures()["is_id_unique"], "uniq")
    rows = mon.run().collect()
    assert [(r["count"], r.uniq) for r in rows] == [(2, 0.0)]  # the unparseable time belongs to no window


def _load_job(name):
    import importlib.util
    spec = importlib.util.spec_from_file_location(name, os.path.join(
        os.path.dirname(os.path.dirname(__file__)), "jobs", f"{name}.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_replay_batches_job(spark, tmp_path):
    job = _load_job("replay_batches")
    lines = ["id,author,downs,created_utc"] + [f"c{k},u{k % 3},{k % 2},{1000 + k}" for k in range(9)]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    records, markers = job.build(spark, {"RECORDS_CSV": str(tmp_path / "r.csv"), "MESSAGES_PER_WINDOW": "2,3"})
    tags = [json.loads(r.value)["blast_id"] for r in records.collect()]
    assert sorted(tags) == [1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert all("id_" in json.loads(r.value) for r in records.collect())
    assert sorted((json.loads(r.value)["blast_id"], json.loads(r.value)["blast_size"]) for r in markers.collect()) \
        == [(1, 2), (2, 3), (3, 2)]


def test_summary_job_on_files(spark, tmp_path):
    job = _load_job("summary_job")
    src = tmp_path / "msgs"
    src.mkdir()
    t0 = 1704067200000  # 2024-01-01T00:00:00Z in epoch ms
    msgs = [("monitor", {"time": t0 + 90}, 0, 100), ("checks", {"checkingTimeMs": 5}, 1, 120),
            ("blast", {"blast_id": 1, "blast_size": 10}, 2, 130), ("monitor", {"time": t0 + 1}, 3, 140)]
    (src / "m.json").write_text("\n".join(json.dumps({"key": k, "value": json.dumps(v), "partition": 0, "offset": o,
                                                      "timestamp": f"2024-01-01T00:00:00.{t:03d}Z"})
                                          for k, v, o, t in msgs) + "\n")
    summary, messages = job.build(spark, {"SOURCE_FORMAT": "json", "SOURCE_PATH": str(src),
                                          "SUMMARY_PATH": str(tmp_path / "out")})
    q = summary.start(messages, trigger={"availableNow": True})
    q.awaitTermination()
    got = sorted((r.tool, r.number_of_windows, r.processing_time, r.window_setting) for r in summary.result().collect())
    assert got == [("checks", 1, 5, "tumbling_10 seconds"), ("monitor", 1, 10, "tumbling_10 seconds")]


def test_quality_job_feeds_summary_job(spark, tmp_path):
    """Result records of one job, kept as message files, summarised by the other."""
    quality, summary_job = _load_job("quality_job"), _load_job("summary_job")
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"id_": f"id{k}", "downs": 0, "controversiality": 0, "author": "u", "created_utc": 10 * k, "blast_id": 1} for k in range(20)]
    (src / "m.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    env = {"WINDOW_TYPE": "tumbling", "WINDOW_DURATION": "1 minutes", "RECORDS": "comments", "SOURCE_FORMAT": "text",
           "SOURCE_PATH": str(src), "OUTPUT_PATH": str(tmp_path / "results"), "OUTPUT_FORMAT": "json", "CHECKPOINT": str(tmp_path / "chk")}
    quality.start(spark, env, trigger={"availableNow": True}).awaitTermination()
    results = spark.read.json(str(tmp_path / "results"))
    n = results.count()
    assert n == 3
    values = [r.value for r in quality.messages_of(results, {"RESULT_KEY": "checks"}).collect()]
    stamp = "2100-01-01T00:00:00.000Z"
    msgs = [{"key": "checks", "value": v, "partition": 0, "offset": i, "timestamp": stamp} for i, v in enumerate(values)]
    msgs.append({"key": "blast", "value": json.dumps({"blast_id": 1, "blast_size": 20}), "partition": 0, "offset": n, "timestamp": stamp})
    (tmp_path / "msgs").mkdir()
    (tmp_path / "msgs" / "m.json").write_text("\n".join(json.dumps(m) for m in msgs) + "\n")
    with pytest.raises(ValueError, match="SUMMARY_PATH"):
        summary_job.build(spark, {"SOURCE_FORMAT": "json", "SOURCE_PATH": str(tmp_path / "msgs")})
    summary, messages = summary_job.build(spark, {"SOURCE_FORMAT": "json", "SOURCE_PATH": str(tmp_path / "msgs"), "SUMMARY_PATH": str(tmp_path / "sum")})
    summary.start(messages, trigger={"availableNow": True}).awaitTermination()
    got = summary.result().collect()
    assert [(r.tool, r.number_of_windows, r.blast_id) for r in got] == [("checks", 3, 1)]
    assert got[0].processing_time is not None and got[0].processing_time > 0


@pytest.mark.parametrize("window", [WindowSpec.tumbling("10 seconds"), WindowSpec.sliding("10 seconds", "5 seconds"), WindowSpec.session("5 seconds")])
@pytest.mark.parametrize("sink", ["path", "operation"])
def test_monitor_start(spark, tmp_path, window, sink):
    src = tmp_path / "in"
    src.mkdir()
    (src / "m.json").write_text("\n".join(json.dumps({"t": t, "id_": f"i{t % 3}"}) for t in [0, 1, 2, 3, 20, 21, 60]) + "\n")
    stream = spark.readStream.schema("t long, id_ string").json(str(src))
    seen = []
    operation = (lambda batch, batch_id: seen.extend(batch.collect())) if sink == "operation" else None
    mon = Monitor(window, "t", time_unit="s", source=stream, sink_operation=operation)
    mon.add(comment_measures()["count"], "n").add(comment_measures()["is_id_unique"], "u")
    q = mon.start(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "chk"), fmt="json", trigger={"availableNow": True})
    q.awaitTermination()
    rows = seen if sink == "operation" else spark.read.json(str(tmp_path / "out")).collect()
    batch = Monitor(window, "t", time_unit="s", source=spark.read.schema("t long, id_ string").json(str(src)), measures=dict(mon.measures)).run()
    want = sorted((r.n, round(r.u, 6)) for r in batch.where("unix_seconds(cast(window_end as timestamp)) <= 60").collect())
    assert sorted((r.n, round(r.u, 6)) for r in rows) == want and want
    assert (tmp_path / "chk").exists()
