"""Every registered query runs at sf0.001; those with oracle SQL match DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from shroud.sources.tables import TABLES

from conftest import SF_SMALL

QUERIES = E.queries()
SQL = E.oracle_sql()


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def canon(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n_docs" in df.columns


def test_oracle_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert canon(got) == canon(want)
