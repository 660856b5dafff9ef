import math

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.plans.sql import SQL
from barloom.plans.storage_sql import SQL_STORED

DIR = "/root/testdata/sf0.001"


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL | SQL_STORED))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute((SQL | SQL_STORED)[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())


def test_every_quote_is_an_order(spark):
    names = entry.queries()
    assert names["order_watch"](spark, DIR).count() == names["quote_dedup"](spark, DIR).count() > 300


def test_chunk_full_matches_quotes_a_minute_old(spark, tmp_path):
    """A trade over the mid of the quote that is a minute old and under that of one 30 seconds old buys."""
    hour = 3600
    rows = [(0, 5, 3, "view", 20.0, 1), (1, 250 * hour + 10, 3, "view", 20.0, 1), (2, 250 * hour + 100, 3, "view", 120.0, 1), (3, 250 * hour + 130, 3, "purchase", 97.0, 2), (4, 310 * hour, 3, "view", 20.0, 1)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, k int")
    events = events.selectExpr("event_id", "cast(timestamp_seconds(1704067200 + s) AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "concat('{\"k\": ', k, '}') AS props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rel = con.execute(SQL_STORED["chunk_full"])
    cols = [d[0] for d in rel.description]
    got = entry.queries()["chunk_full"](spark, str(tmp_path)).select(*cols).collect()
    assert [r.buy_volume for r in got if r.buy_volume] == [3.0]
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in rel.fetchall())
