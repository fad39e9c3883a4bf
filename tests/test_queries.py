"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tallyforge.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,order", [
    ("metric_revenue_by_day_country", "1 ASC NULLS LAST, 2 ASC NULLS LAST"),
    ("metric_top_products_per_week", "week_start ASC NULLS LAST, revenue_usd DESC NULLS FIRST, sku ASC NULLS LAST"),
    ("metric_paid_vs_refunded_counts", "paid_orders DESC NULLS FIRST, country ASC NULLS LAST"),
])
def test_metrics_are_sorted(spark, duck, name, order):
    got = QUERIES[name](spark, SF)
    want = duck.sql(f"SELECT * FROM ({ORACLE[name]}) ORDER BY {order}")
    assert got.columns == want.columns
    assert [tuple(r) for r in got.collect()] == want.fetchall()
