"""Every query with SQL gives the rows of its SQL, on the smallest test tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SONDAGE_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    r = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    rows = lambda cols, data: sorted(repr([norm(x[cols.index(c)]) for c in sorted(cols)]) for x in data)
    assert rows(df.columns, df.collect()) == rows(list(r.columns), r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).schema.fieldNames() == ["l_orderkey", "lines", "total_qty", "max_qty"]


def test_rows_only_queries(spark):
    for name in ("q_pagerank30", "q_rules_all"):
        entry.queries()[name](spark, DATA).collect()
