"""Comparing a Spark result with DuckDB's, columns by name and rows in any order."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, (str, bytes)):
        return v
    return float(v)


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(map(_value, r)) for r in frame[names].itertuples(index=False)), key=repr)


def assert_same(spark_frame, con, sql):
    got, want = spark_frame.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    assert rows(got) == rows(want)
