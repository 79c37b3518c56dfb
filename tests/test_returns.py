"""Returns against a value of zero are those of SQL: infinite, or missing where both values are zero."""

import datetime as dt

import duckdb
import pytest

from tidewater import queries as core


@pytest.mark.parametrize("name", ["return", "roc", "rocp", "rocr"])
def test_a_zero_before(spark, tmp_path, name):
    begin = dt.datetime(2024, 1, 1)
    values = [0.0, 0.0, 5.0, 0.0, 7.25, 0.0, 3.1, 0.0, 0.0, 12.5, 0.4]
    rows = [(i + 1, begin + dt.timedelta(minutes=i), i // 22, "click", values[i % 11]) for i in range(66)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(core.oracle_sql()[name]).fetchall())
    got = {r["event_id"]: r["out"] for r in core.queries()[name](spark, str(tmp_path)).collect()}
    assert float("inf") in want.values() and None in want.values()
    assert got == want
