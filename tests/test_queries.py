"""Every registered query of the series operators against its DuckDB text, on the smallest tables."""

import datetime
import glob
import math
import os
import random

import duckdb
import pytest

from serion.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def _sorted(rows):
    return sorted(rows, key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = _sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    r = duck.execute(catalog.ORACLES[name])
    at = {x[0]: k for k, x in enumerate(r.description)}
    assert sorted(at) == names
    assert got == _sorted(tuple(_plain(x[at[c]]) for c in names) for x in r.fetchall())


def test_campaigns_of_all_events(spark, duck):
    """Every event is a campaign, whatever its number."""
    day = lambda ts: f"epoch_us({ts}) // 86400000000"
    lines = duck.execute(f"SELECT l_orderkey, l_linenumber, l_suppkey, {day('o_orderdate')}, greatest({day('l_shipdate')}, {day('o_orderdate')}) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    events = duck.execute(f"SELECT event_id, user_id % 10 + 1, {day('ts - INTERVAL 26 YEARS')}, value FROM events").fetchall()
    want = []
    for i, supplier, first, value in events:
        last = first + math.floor(value) % 3 + (1000 if i % 1000 == 0 else 0)
        want += [(o, n, i) for o, n, s, a, b in lines if s == supplier and a <= last and first <= b]
    assert {i % 4 for _, _, i in want} == {0, 1, 2, 3}
    assert sorted(map(tuple, catalog.QUERIES["overlapping_spans"](spark, SF).collect())) == sorted(want)


def test_busy_spans_of_odd_lines(spark, tmp_path):
    """Lines without a day, a quantity or a supplier, of negative and halved quantities, and of days before 1970."""
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_shipdate TIMESTAMP)")
    pick = random.Random(4)
    rows = [(i, pick.choice([None, 1, 2, 3]), pick.choice([None, 0.5, 2.5, 3.5, -1.0, -3.0, 4.0, 11.0]), pick.choice([None, *[datetime.datetime(1969, 9, 1) + datetime.timedelta(hours=pick.randrange(9000))] * 9])) for i in range(200)]
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", [*rows, *[(500 + i, 4, q, None) for i, q in enumerate((None, 2.0, 2.0))]])
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    got = catalog.QUERIES["busy_spans"](spark, str(tmp_path))
    assert got.columns == ["l_suppkey", "d1", "d2", "lines"]
    assert got.agg({"lines": "sum"}).first()[0] == 203
    # the SQL sorts twice and leaves open how equal lines stand; here they stand alike both times
    sql = catalog.ORACLES["busy_spans"].replace("ORDER BY d1, d2", "ORDER BY d1, d2, l_orderkey").replace("SELECT l_suppkey, epoch_us", "SELECT l_orderkey, l_suppkey, epoch_us")
    assert _sorted(map(tuple, got.collect())) == _sorted(con.execute(sql).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
