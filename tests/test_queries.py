"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tallyspark import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", plans.QUERIES)
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    want = sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_gate_holds(spark):
    row = plans.QUERIES["reconciliation_gate"](spark, DATA).first()
    assert row.checked > 0 and row.failed == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["anti_join_is_null"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_extendedprice" not in plan


def test_swaps_deal_filings_once(spark):
    """Line items are scanned once, and a pair's filings are dealt once."""
    plan = plans.QUERIES["swaps"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(registrant") == 1
