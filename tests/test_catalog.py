"""Every registered query with SQL gives the same rows in both engines; the others run."""

from __future__ import annotations

import datetime
import os

import pytest

DIR = os.environ.get("HARVEST_TEST_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


from harvest import catalog  # noqa: E402


def _same(spark, duck, f, sql):
    df = f(spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    _same(spark, duck, catalog.QUERIES[name], catalog.ORACLES.get(name))


@pytest.mark.parametrize("name", sorted(catalog.CASES))
def test_case(spark, duck, name):
    _same(spark, duck, *catalog.CASES[name])


def test_search_page_is_a_top_k(spark):
    plan = catalog.QUERIES["search_limit_reset"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
