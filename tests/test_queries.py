"""Every query with SQL against DuckDB, and those without against their plain models' properties."""

import duckdb
import pytest

import __spark_entry__ as entry
from vellum import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_duckdb(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cur = duck.execute(plans.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(range(len(names)), key=names.__getitem__)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark):
    """Range filter and columns reach the scan; nothing is a cartesian product."""
    plan = plans.QUERIES["daily_series"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("interval_nearest", "forward_fill_asof", "missing_and_unused"):
        assert "Cartesian" not in plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
