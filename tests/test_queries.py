"""Every query with SQL gives DuckDB's rows; the others give rows."""

import os

import duckdb
import pytest

from joulemark.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: None if v is None or v != v else f"{v:.6g}".replace("-0", "0") if isinstance(v, float) and v == 0 else f"{v:.6g}" if isinstance(v, float) else str(v)
    return cols, sorted((tuple(map(text, r)) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_union_partitions_on_repeated_events(spark, tmp_path):
    duck = duckdb.connect()
    more = f"SELECT event_id + 1000 * k AS event_id, CASE WHEN event_id % 100 > 0 THEN ts END AS ts, user_id + 400 * k AS user_id, event_type, value, props FROM '{DATA}/events.parquet', range(3) r(k)"
    duck.execute(f"COPY ({more}) TO '{tmp_path}/events.parquet'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(QUERIES["union_partitions"](spark, str(tmp_path)).toPandas()) == rows(duck.execute(SQL["union_partitions"]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
