"""Crawls against a row model; settings, folders and the scan's state."""

from __future__ import annotations

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from harvest.functions import dates, html
from harvest.sources import config, crawl
from harvest.streaming.scan import Scan


def test_reach_model(spark):
    rng = random.Random(3)
    edges = {i: rng.choice([None, *range(60)]) for i in range(60)}
    want = set()
    for s in range(0, 60, 7):
        at, seen = s, {}
        while at is not None and at not in seen:
            seen[at] = len(seen)
            at = edges.get(at)
        want |= {(s, u, n) for u, n in seen.items()}
    e = spark.createDataFrame(list(edges.items()), "url long, next long")
    got = crawl.reach(e, spark.createDataFrame([(s,) for s in range(0, 60, 7)], "url long"))
    assert {tuple(r) for r in got.select("seed", "url", "depth").collect()} == want


def test_reach_of_nothing(spark):
    none = spark.createDataFrame([], "url string, next string")
    assert crawl.reach(none, none.select("url")).count() == 0


def test_site_crawl(spark):
    links = spark.createDataFrame([(0, "https://x.example/careers/positions/1", "One"), (1, "https://x.example/careers/positions/1/", "Again"), (2, "https://x.example/about", "No")], "pos int, url string, title string")
    page = '<div class="section__body sec-body"><p>Requirements</p><ul><li>A</li><li>B</li></ul></div>'
    fetched = spark.createDataFrame([("https://x.example/careers/positions/1", page)], "url string, html string")
    assert [tuple(r) for r in crawl.crawl_site(links, fetched, "site_sections").collect()] == [("https://x.example/careers/positions/1", "One", "A • B")]


@pytest.mark.parametrize(("s", "want"), [("250ms", 250), ("1h30m", 5_400_000), ("5m", 300_000), ("", 7), ("0s", 7), ("5 apples", 7), (None, 7)])
def test_duration(s, want):
    assert config.duration_ms(s, 7) == want


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("http: {burst: 9}\ngood_keywords: [spark]\nllm_enabled: true\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c["http"], c["good_keywords"], c["llm_enabled"]) == ({"rate": 2.0, "burst": 9, "attempts": 4}, ["spark"], True)
    m = config.merge_form(c, {"bad_keywords": "a, b;c", "strong_threshold": "x", "heuristic_threshold": "0.4", "apply_form.email": " e@x.example ", "cv_profile": ""})
    assert (m["bad_keywords"], m["good_keywords"], m["strong_threshold"], m["heuristic_threshold"]) == (["a", "b", "c"], ["spark"], 0.0, 0.4)
    assert m["llm_enabled"] is False and m["apply_form"] == {"email": "e@x.example"} and "cv_profile" not in m
    assert c["llm_enabled"] is True


def test_folders_and_files(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r["name"] for r in config.documents_in(spark, str(tmp_path)).collect()) == ["B.PDF", "a.pdf"]
    rows = [{"name": " A ", "careers_url": "u1", "active": True}, {"name": "A", "careers_url": "u2"}, {"name": " "}]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=1))
    got = config.companies_json(spark, str(tmp_path / "c.json")).withColumn("pos", F.monotonically_increasing_id())
    assert [(r["name"], r["careers_url"]) for r in config.seed_companies(got).collect()] == [("A", "u1")]


def test_page_details_places(spark):
    page = '<title>T</title><h1> Dev </h1><div class="location"> </div><div data-location="x">Haifa</div><time datetime="2024-01-02T03:04:05Z">x</time><time datetime="2025-01-02T03:04:05Z">y</time><div class="posted-date">soon</div><article>' + "long text " * 20 + "</article>"
    r = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(html.page_details("h").alias("x")).collect()
    assert (r[0].x.title, r[0].x.location, r[0].x.date, len(r[0].x.description)) == ("Dev", "Haifa", "2024-01-02T03:04:05Z", 199)
    assert set(r[1].x) == set(r[2].x) == {""}


def test_dates_without_input(spark):
    r = spark.createDataFrame([(None,)], "h map<string, string>").select(dates.header_date(F.col("h")), dates.meta_date(F.lit(None).cast("array<string>"))).first()
    assert tuple(r) == (None, None)


def test_scan_state():
    gate, rows, done = threading.Event(), [], []
    scan = Scan(on_rows=lambda n, r: rows.append((n, r)), on_done=done.append)

    def fails():
        raise ValueError("no page")

    assert scan.start([("a", lambda: gate.wait(5) and 1), ("b", fails), ("c", lambda: 3)])
    assert not scan.start([("z", lambda: 0)]) and scan.status()["running"]
    gate.set()
    end = scan.join(10)
    assert rows == [("a", 1), ("c", 3)] and end == {"running": False, "done": 3, "total": 3, "percent": 100, "error": "b: no page"} and done == [end]
    gate.clear()
    assert scan.start([("a", lambda: gate.wait(5)), ("b", lambda: 2)])
    scan.cancel()
    gate.set()
    assert scan.join(10)["done"] <= 1 and not scan.status()["running"]
