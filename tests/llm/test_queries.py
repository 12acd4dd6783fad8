"""The registered queries against their DuckDB twins, and their contracts' columns."""

import re

import pytest

import __spark_entry__ as E
from oracle import compare, duck
from winsight.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_all_registered():
    names = set(E.queries())
    assert {"pipeline", *Q.queries()} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, name):
    assert compare(Q.queries()[name](spark, SF), duck(SF), Q.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op1_preferences", "op3_line_dedup", "op4_decontaminate", "op6_mix", "op10_exact_dedup"])
def test_native_plans(spark, name):
    """DataFrame functions only, and no cross join."""
    df = Q.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_one_row_per_document(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() == df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
