"""Every query with an SQL oracle matches DuckDB on sf0.001 (row count,
column names, order-insensitive values rounded to 6 places)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["column", "corr"]
    assert len(df.collect()) == 5


def test_every_query_has_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    hs, ls = digest(sdf.columns, s_rows)
    hd, ld = digest(d_cols, d_rows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])
