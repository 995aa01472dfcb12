"""Every registered usage query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillmeter import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.7f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_filter_stays_above_the_window_and_prices_are_broadcast(spark):
    from quillmeter.options import UsageQuery

    plan = queries._costed(spark, DATA, UsageQuery(group="model", from_ms=1))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and plan.index("Filter") < plan.index("Window")


def test_equal_events_of_two_users_count_twice(spark, duck, tmp_path):
    """A table repeated with shifted keys: the same times and counters in logs of other users."""
    duck.execute(f"COPY (SELECT event_id + r * 1000 AS event_id, ts, user_id + r * 15 AS user_id, event_type, value, props FROM events, range(2) t(r)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = queries.QUERIES["maintained_usage"](spark, str(tmp_path))
    sql = duck.execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet') SELECT {', '.join(rows.columns)} FROM ({queries.SQL['maintained_usage']})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(sql)
