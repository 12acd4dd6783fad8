"""Side-by-side check of a Spark query and its DuckDB twin (order-insensitive)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, (pd.Timestamp,)):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        try:
            return v.replace(tzinfo=None).isoformat()
        except TypeError:
            return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=repr)


def compare(spark_df, con, sql: str):
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    problems = []
    if sorted(s.columns) != sorted(d.columns):
        problems.append(f"columns spark={sorted(s.columns)} duck={sorted(d.columns)}")
        return problems
    if len(s) != len(d):
        problems.append(f"rows spark={len(s)} duck={len(d)}")
    rs, rd = rows_of(s), rows_of(d)
    if rs != rd:
        diff = [(a, b) for a, b in zip(rs, rd) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems
