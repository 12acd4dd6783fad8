"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _core():
    """The reference's operators; the training-data queries have tests of their own."""
    llm = E._llm()
    return sorted(set(E.queries()) - set(llm.queries() if llm else ()))


@pytest.mark.parametrize("name", _core())
def test_query_matches_oracle(spark, con, name):
    assert name in E.oracle_sql(), "every query of this set has a SQL twin"
    assert compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name]) == []


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "num_failed" in df.columns


@pytest.mark.parametrize("name", ["sliding_measures", "session_counts", "rows_of_window", "epoch_ms", "parse_ts",
                                  "stream_tumbling"])
def test_results_do_not_depend_on_session_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[name](spark, SF)
        assert compare(df, con, E.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
