"""Queries against their SQL on rows that the small tables lack."""

from __future__ import annotations

import pytest

pytest.importorskip("duckdb")


def both(spark, tmp_path, name, table, rows, columns):
    """The rows of a query and of its SQL over one table, in order."""
    import duckdb

    from harvest import catalog

    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in got.description]
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=str), sorted(got.fetchall(), key=str)


def test_error_classes_of_users_whose_number_holds_429(spark, tmp_path):
    got, want = both(spark, tmp_path, "error_classes", "events", [(k, u, "view") for k, u in enumerate([429] * 6 + [1429] * 6 + [7] * 6)], "event_id long, user_id long, event_type string")
    assert got == want and sum(x[1] for x in want) == 6


def test_pages_source_of_addresses_that_repeat(spark, tmp_path):
    urls = ["https://a.example.com/fr/1", "https://a.example.com/fr/1", "https://b.example.net/1", "https://b.example.net/1", "https://blog.a.example.com/x", "https://a.example.com/#x", "https://a.example.com/#x"]
    got, want = both(spark, tmp_path, "pages_source", "pages", [(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert got == want and len(got) == len(urls)


def test_answers_are_the_same_in_a_workers_next_run():
    from harvest.plans.crawls import Answers

    assert [Answers("https://a.example.com/fr/2")[0] for _ in range(4)] == [503, 200, 503, 200]


CUT = [(k, f"https://a.example.com/{k}", f"<html><head><title>{t}</title></head><body>{h}<article>{'word ' * 30}{t}</article></body></html>") for k, (t, h) in enumerate([("R&amp;D &amp", "<h1>R&amp;D &amp</h1>"), ("a &amp", ""), ("&quot;q&quot", "<h1>&quot;q&quot</h1>"), ("x &lt; y", "<h1>x &lt y</h1>")])]


@pytest.mark.parametrize("name", ["page_details", "enrich_company"])
def test_entities_that_are_cut(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, "pages", CUT, "page_id long, url string, html string")
    assert got == want and len(got) == len(CUT)


def test_entities_with_and_without_an_end():
    from harvest.functions import html

    assert html.ended("&amp;&amp &lt; &#39;&#x41; &none; &copy2 &amp;lt;") == "&&amp < 'A &none; &copy2 &lt;"
    assert html.parse("&amp;&amp").all_text() == "&&" and html.parse("&amp;&amp", html.ended).all_text() == "&&amp"
