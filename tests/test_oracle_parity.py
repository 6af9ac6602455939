"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import hashlib

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from codesieve.plans import catalog
from codesieve.plans.fixtures import BASE_TABLES
from tests.conftest import SF_SMALL

NAMES = sorted(catalog.SPARK)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5(repr(tuple(r[i] for i in order)).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLE) == set(catalog.SPARK)
    assert set(catalog.SPARK) <= set(queries()) and set(catalog.ORACLE) <= set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["repo_url", "snapshot_id", "doc_id", "path", "classification", "topic", "feedback"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, duck, name):
    df = catalog.SPARK[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.sql(catalog.ORACLE[name]())
    o_cols = res.columns
    o_rows = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    idx = [o_cols.index(c) for c in df.columns]
    o_rows = [tuple(r[i] for i in idx) for r in o_rows]
    assert len(s_rows) == len(o_rows)
    assert _digest(s_rows, df.columns) == _digest(o_rows, df.columns)
