"""Every query with SQL gives the rows that DuckDB gives on the same tables; the others run and keep their schema."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans.registry import ORACLES, QUERIES

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, numbers.Number):
        return float(x)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.columns and not got.isEmpty()
        return
    want = duck.sql(ORACLES[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(near(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), [(r, s) for r, s in zip(a, b, strict=True) if r != s][:3]
