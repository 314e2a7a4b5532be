"""Comparison of a query with its SQL on small tables."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(d=DATA):
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    name = type(x).__name__
    if name.startswith("bool"):
        return bool(x)
    if "int" in name:
        return int(x)
    if "float" in name or name == "Decimal":
        return round(float(x), 9)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


def assert_same(query, sql, spark, d=DATA):
    a, b = query(spark, d).toPandas(), connect(d).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
