"""Every registered query of the core with SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from tamarack.queries import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.9g" % float(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(plain(tuple(r[i] for i in at))) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_sql_only_for_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
