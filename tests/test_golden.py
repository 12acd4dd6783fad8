"""Golden micro-fixtures (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from winsight import Suite, WindowSpec, windowed_measures
from winsight.operators import measures as M

T0 = dt.datetime(2024, 1, 1)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_g1_session_boundary(spark):
    df = spark.createDataFrame([(at(s),) for s in (0, 5, 9, 14, 15, 30)], "ts timestamp_ntz")
    out = windowed_measures(df, WindowSpec.session("5 seconds"), "ts", {"n": M.size()}).orderBy("window_start")
    assert [(r.window_start, r.window_end, r.n) for r in out.collect()] == [(at(0), at(20), 5), (at(30), at(35), 1)]


def test_g1_session_matches_spark_native(spark):
    df = spark.createDataFrame([(at(s),) for s in (0, 5, 9, 14, 15, 30)], "ts timestamp_ntz")
    native = df.groupBy(F.session_window("ts", "5 seconds").alias("w")).count() \
        .select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "count")
    ours = windowed_measures(df, WindowSpec.session("5 seconds"), "ts", {"count": M.size()}) \
        .select(F.col("window_start").alias("s"), F.col("window_end").alias("e"), "count")
    assert sorted(native.collect()) == sorted(ours.collect())


REDDIT = (Suite("Reddit checks").is_complete("id_").is_unique("id_")
          .has_min("downs", lambda v: v >= 0).has_mean("controversiality", lambda v: v < 0.05)
          .has_completeness("author", lambda v: v > 0.9))
REDDIT_SCHEMA = "id_ string, downs int, controversiality int, author string, ts timestamp_ntz"


def _one_window(spark, rows, schema=REDDIT_SCHEMA):
    return spark.createDataFrame([(*r, at(1)) for r in rows], schema)


def test_g4_reddit_suite(spark):
    df = _one_window(spark, [("a", 0, 0, "x"), ("b", 0, 0, None), ("b", 1, 1, "y"), (None, -1, 0, "z")])
    r = REDDIT.evaluate(df, WindowSpec.tumbling("1 minutes"), "ts").collect()[0]
    assert r.num_failed == 5 and r.batch_size == 4
    assert abs(r.is_complete_id_ - 0.75) < 1e-12 and abs(r.is_unique_id_ - 1 / 3) < 1e-12
    assert r.has_min_downs == -1 and abs(r.has_mean_controversiality - 0.25) < 1e-12
    assert abs(r.has_completeness_author - 0.75) < 1e-12


def test_g4_clean_and_all_null(spark):
    ok = _one_window(spark, [("a", 0, 0, "x"), ("b", 0, 0, "y")])
    assert REDDIT.evaluate(ok, WindowSpec.tumbling("1 minutes"), "ts").collect()[0].num_failed == 0
    nulls = _one_window(spark, [(None, None, None, None), (None, None, None, None)])
    assert REDDIT.evaluate(nulls, WindowSpec.tumbling("1 minutes"), "ts").collect()[0].num_failed == 5


def test_g5_products_suite(spark):
    suite = (Suite("Products").is_complete("id_").is_unique("id_").has_max("numViews", lambda v: v < 90)
             .is_contained_in("priority", ["high", "medium", "low"]).is_non_negative("numViews"))
    df = spark.createDataFrame([("a", "high", 5, at(1)), ("b", "normal", 89, at(2)), ("c", None, None, at(3))],
                               "id_ string, priority string, numViews bigint, ts timestamp_ntz")
    r = suite.evaluate(df, WindowSpec.tumbling("1 minutes"), "ts").collect()[0]
    assert r.num_failed == 1 and r.is_contained_in_priority_ok is False and r.has_max_numViews == 89


def test_verdict_rows(spark):
    df = _one_window(spark, [("a", 0, 0, "x"), ("b", 0, 0, None)])
    res = REDDIT.evaluate(df, WindowSpec.tumbling("1 minutes"), "ts")
    rows = {r.constraint: r.ok for r in REDDIT.verdict_rows(res).collect()}
    assert rows == {"is_complete_id_": True, "is_unique_id_": True, "has_min_downs": True,
                    "has_mean_controversiality": True, "has_completeness_author": False}


def test_g6_json_decode(spark):
    from winsight.sources.messages import decode_json
    schema = T.StructType([T.StructField(n, t) for n, t in [("gilded", T.IntegerType()), ("ups", T.IntegerType()),
                           ("blast_id", T.StringType()), ("edited", T.IntegerType()), ("score", T.IntegerType()),
                           ("downs", T.IntegerType())]])
    good = '{"gilded":"0","ups":3,"blast_id":1,"edited":"","score":null,"downs":1.0}'
    df = spark.createDataFrame([(good,), ('{"ups": 3',), ("plain text",), ("[1,2]",)], "value string")
    rows = decode_json(df, schema).collect()
    assert tuple(rows[0]) == (None, 3, "1", None, None, None)
    assert all(all(v is None for v in r) for r in rows[1:])


def test_g7_casts(spark):
    from winsight.functions.casts import safe_cast
    from winsight.functions.time import parse_ts
    df = spark.createDataFrame([("x",), ("",), (" 7 ",), ("1.0",)], "v string")
    assert [r.v for r in safe_cast(df, {"v": "int", "missing": "int"}).collect()] == [None, None, 7, None]
    bad = spark.createDataFrame([("bad",), ("2024-01-01 10:00:00.250",)], "t string")
    got = [r.p for r in bad.select(parse_ts("t").alias("p")).collect()]
    assert got[0] is None and got[1] is not None


def test_g8_batches(spark):
    from winsight.operators.batches import assign_batches, batch_markers, parse_sizes
    df = spark.range(9).withColumnRenamed("id", "pos")
    b = assign_batches(df, "pos", parse_sizes("2, 3"), block=4)
    assert [r.batch_id for r in b.orderBy("pos").collect()] == [1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert sorted(tuple(r) for r in batch_markers(b).collect()) == [(1, 2), (2, 3), (3, 2)]


def test_g9_segments(spark):
    from winsight.operators.runs import run_summary
    msgs = spark.createDataFrame([
        (0, 0, "b", '{"checkingTimeMs": 5}', 100), (0, 1, None, '{"time": 90}', 97),
        (0, 2, "blast", '{"blast_id": 1, "blast_size": 10}', 98), (0, 3, "b", '{"checkingTimeMs": 9}', 120)],
        "partition int, offset long, key string, value string, ms long")
    msgs = msgs.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")
    out = run_summary(msgs, "blast", ["a", "b"], "a")
    got = sorted((r.tool, r.blast_id, r.blast_size, r.number_of_windows, r.max_timestamp, r.processing_time,
                  r.blast_start_time) for r in out.collect())
    assert got == [("a", 1, 10, 1, 97, 7, -1), ("b", 1, 10, 1, 100, 5, -1)]


def test_g10_runs(spark):
    from winsight.operators.runs import latest_by_run, run_elapsed, run_stats
    t = spark.createDataFrame([("r1", "f1", 4000), ("r1", "f2", 5000), ("r2", "f1", 1), ("r2", "f2", 2),
                               ("r2", "f3", 3)], "run string, file string, timestamp long")
    lat = latest_by_run(t)
    assert sorted((r.run, r.latest, r.n_files) for r in lat.collect()) == [("r1", 5000, 2), ("r2", 3, 3)]
    lat = latest_by_run(t, max_files=2)  # the rule that leaves out runs with more files, on request
    assert [(r.run, r.latest) for r in lat.collect()] == [("r1", 5000)]
    assert run_elapsed(lat, 1000, 10, 100).collect()[0].elapsed == 3000
    st = run_stats(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0)], "run string, value double")) \
        .collect()[0]
    assert abs(st.mean - 2.333333) < 1e-6 and abs(st.std - 1.247219) < 1e-6


def test_g12_csv_cells(spark, tmp_path):
    from winsight.sources.files import read_records_csv
    p = tmp_path / "r.csv"
    p.write_text('a,b,c\n1,,"x\ny"\n2,"",z\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()),
                           T.StructField("c", T.StringType())])
    rows = read_records_csv(spark, str(p), schema).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(1, "", "x\ny"), (2, "", "z")]
    raw = read_records_csv(spark, str(p), schema, fill_empty_strings=False).orderBy("a").collect()
    assert raw[0].b is None and raw[1].b is None
