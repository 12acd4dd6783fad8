import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from winsight import WindowSpec
from winsight.functions.labels import route_by_key, window_label
from winsight.sources.files import layout_for, read_run_start, read_timings_csv, read_values_text
from winsight.sources.messages import decode_json, read_messages, to_messages
from winsight.sources.sinks import results_path, write_results


def test_timing_layouts(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text("x,timestamp\n1,10\n2,30\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("time,y\n40,1\n50,2\n")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("1,60\n2,70\n")
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "a.csv").write_text("1,2,80\n3,4,90\n")
    want = {"h": ("headered", 30), "t": ("headered_time", 50), "two": ("two", 70), "three": ("three", 90)}
    for folder, (layout, latest) in want.items():
        df = read_timings_csv(spark, str(tmp_path / folder), layout)
        assert df.agg(F.max("timestamp")).first()[0] == latest
        assert df.first().file.endswith("a.csv")
    assert layout_for("run-x-alpha", {"alpha": "two"}) == "two"
    assert layout_for("run-y", {"alpha": "two"}) == "three"


def test_values_and_report(spark, tmp_path):
    (tmp_path / "v.txt").write_text(" 1.5 \n2\n\n4.5\n")
    vals = read_values_text(spark, str(tmp_path / "v.txt"))
    assert sorted(r.value for r in vals.collect()) == [1.5, 2.0, 4.5]
    (tmp_path / "r.json").write_text(json.dumps({"start": 1234, "other": 1}, indent=2))
    assert read_run_start(spark, str(tmp_path / "r.json")).first().start == 1234


def test_messages_roundtrip_and_file_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5)], "id long, s string, v double")
    msgs = to_messages(df, "k")
    back = decode_json(msgs, df.schema, keep=["key"]).first()
    assert (back.key, back.id, back.s, back.v) == ("k", 1, "a", 2.5)
    (tmp_path / "m.json").write_text('{"id": 7, "s": "x", "v": 1.0}\n')
    batch = read_messages(spark, "json", path=str(tmp_path), schema=df.schema, streaming=False)
    assert batch.first().id == 7
    assert read_messages(spark, "json", path=str(tmp_path), schema=df.schema).isStreaming


def test_labels_and_routes(spark):
    df = spark.createDataFrame([("Tumbling", "10 s", None, None), ("sliding", "10 s", "5 s", None),
                                ("SESSION", None, None, "5 s"), ("other", "1 s", None, None)],
                               "k string, d string, s string, g string")
    got = [r.l for r in df.select(window_label("k", "d", "s", "g").alias("l")).collect()]
    assert got == ["tumbling_10 s", "sliding_10 s_5 s", "session_None_5 s", None]
    keys = spark.createDataFrame([(b"checker",), (None,), (b"x",)], "key binary")
    assert [r.s for r in keys.select(route_by_key("key", ["checker"], "stream").alias("s")).collect()] \
        == ["checker", "stream", "stream"]
    assert WindowSpec.session("5 s").label() == "session_None_5 s"


def test_write_results_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"")], "n int, s string")
    path = results_path(str(tmp_path), WindowSpec.sliding("10 minutes", "5 minutes"))
    assert path.endswith("sliding_10minutes_5minutes")
    write_results(df, path)
    write_results(df, path)
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)
    assert back.count() == 2 and back.first().s == 'a,"b"'


def test_assign_windows_rejects_sessions(spark):
    import pytest
    from winsight.operators.windows import assign_windows
    df = spark.createDataFrame([(1,)], "x int").select(F.current_timestamp().alias("ts"))
    with pytest.raises(ValueError):
        assign_windows(df, WindowSpec.session("5 seconds"), "ts")
    w = assign_windows(df, WindowSpec.sliding("10 seconds", "5 seconds"), "ts")
    assert w.count() == 2 and T.StructType in [type(f.dataType) for f in w.schema.fields]


def test_elapsed_values_roundtrip(spark, tmp_path):
    """A5 -> A6 -> value files -> S5 -> A7: the extractor/plotter loop on Spark."""
    from winsight.operators.runs import latest_by_run, run_elapsed, run_stats
    from winsight.sources.files import parent_dir
    from winsight.sources.sinks import write_values_text
    for run, files in {"r1": {"a.csv": [10, 40], "b.csv": [30]}, "r2": {"a.csv": [25]},
                       "r3": {"a.csv": [1], "b.csv": [2], "c.csv": [3]}}.items():
        (tmp_path / "t" / run).mkdir(parents=True)
        for name, stamps in files.items():
            (tmp_path / "t" / run / name).write_text("".join(f"0,0,{x}\n" for x in stamps))
    t = read_timings_csv(spark, str(tmp_path / "t" / "*"), "three").withColumn("run", parent_dir("file"))
    el = run_elapsed(latest_by_run(t), 5, elements=2, sleep=1.0)
    assert sorted((r.run, r.elapsed) for r in el.collect()) == [("r1", 33.0), ("r2", 18.0), ("r3", -4.0)]
    write_values_text(el, str(tmp_path / "v"), "elapsed", "run")
    write_values_text(el, str(tmp_path / "v"), "elapsed", "run")  # a second experiment appends
    vals = read_values_text(spark, str(tmp_path / "v")).withColumn("run", F.substring_index(parent_dir("file"), "=", -1))
    st = {r.run: (r.n, r.mean, r.std) for r in run_stats(vals).collect()}
    assert st == {"r1": (2, 33.0, 0.0), "r2": (2, 18.0, 0.0), "r3": (2, -4.0, 0.0)}


def test_stream_file_sink_and_each_batch(spark, tmp_path):
    """K3 and K5: a closed-window stream to a CSV folder, and a per-micro-batch hook."""
    from winsight.operators import measures as M
    from winsight.plans.aggregate import windowed_measures
    from winsight.sources.sinks import each_batch, stream_to_files
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"t": t, "id": f"i{t % 3}"}) + "\n" for t in range(0, 50, 5)))
    stream = spark.readStream.schema("t long, id string").json(str(src)) \
        .withColumn("ts", F.timestamp_seconds("t"))
    res = windowed_measures(stream, WindowSpec.tumbling("20 seconds"), "ts", {"n": M.size()})
    q = stream_to_files(res, str(tmp_path / "csv"), str(tmp_path / "chk1"), "csv", trigger={"availableNow": True})
    q.awaitTermination()
    back = spark.read.schema("window_start timestamp, window_end timestamp, n long").option("header", True) \
        .csv(str(tmp_path / "csv"))
    assert sorted(r.n for r in back.collect()) == [4, 4]  # [40, 60) is still open
    seen = []
    q2 = each_batch(res, lambda df, bid: seen.append((bid, df.count())), str(tmp_path / "chk2"),
                    trigger={"availableNow": True})
    q2.awaitTermination()
    assert sum(n for _, n in seen) == 2
