"""Every registered query of the flow engine against its SQL, in two engines."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from rillflow.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple(float(x) if isinstance(x, (float, decimal.Decimal)) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x for x in row)


def ordered(rows):
    return sorted(map(plain, rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    cur = duck.sql(ORACLE_SQL[name])
    assert sorted(cur.columns) == cols
    at = [cur.columns.index(c) for c in cols]
    assert ordered(tuple(r[c] for c in cols) for r in df.collect()) == ordered(tuple(r[i] for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
