"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pytest

from tidewater import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "events"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{SF}/events.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, con, name):
    got, want = core.queries()[name](spark, SF).toPandas(), con.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in got.columns if c in ("event_id", "user_id", "event_type", "ts")]
    rest = [c for c in got.columns if c not in keys]
    got, want = (d.sort_values([*keys, *rest]).reset_index(drop=True) for d in (got, want))
    for c in rest:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, err_msg=c)


def test_queries_without_sql_run(spark):
    for name in set(core.queries()) - set(core.oracle_sql()):
        assert core.queries()[name](spark, SF).count() > 0, name


def test_rolling_queries_reach_the_block_forms(spark):
    """The block form of every operator that has one stands behind a query with SQL."""
    from tidewater.operators.fast import FAST, FAST_FROM

    wide = {n for n in core.oracle_sql() if "_20" in n}
    for n in wide:
        plan = core.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan, n
    assert FAST_FROM <= 20
    assert {core.snake(n) + "_20" for n in FAST if not n.startswith("_") and n != "MovingAverage"} <= wide
