"""Every SQL-expressible registered query equals its DuckDB twin (whole tables)."""
import pytest

import __spark_entry__ as E
from daycast.plans.check import compare, duckdb_conn
from conftest import SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    res = compare(E.queries()[key](spark, SMALL), con, SQL[key])
    assert res["ok"], res


def test_every_query_has_an_entry():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 45


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 77
    assert df.count() > 0
