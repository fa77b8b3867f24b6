"""The store's operations, fetching, and feeds as streams, against row models and fixed results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from harvest.operators import relational as R
from harvest.sources import datasource, fetch, repo
from harvest.sources.store import Store
from harvest.streaming import feed


def test_repo(spark, tmp_path):
    NOW, LATER = (F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp") for k in (1, 2))
    r = repo.Repo(spark, str(tmp_path / "r"))
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    ids = {x["name"]: x["id"] for x in r.upsert_companies_by_name(frame([("A", "u1"), ("B", "u2"), ("A", "u3")], "name string, careers_url string"), NOW).collect()}
    again = {x["name"]: x["id"] for x in r.upsert_companies_by_name(frame([("B", "u4"), ("C", "u5")], "name string, careers_url string"), LATER).collect()}
    assert again["B"] == ids["B"] and len(ids["A"]) == 32
    rows = {x["name"]: x for x in r.list_companies().collect()}
    assert [x["name"] for x in r.list_companies().collect()] == ["A", "B", "C"]
    assert (rows["A"]["careers_url"], rows["B"]["careers_url"], str(rows["B"]["created_at"]), str(rows["B"]["updated_at"])) == ("u3", "u4", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    r.upsert_companies(frame([(ids["A"], "A2", "u9", False)], "id string, name string, careers_url string, active boolean"), LATER)
    assert [x["name"] for x in r.list_companies().collect()] == ["B", "C"]

    made = "company_id string, title string, url string, discovered_at timestamp"
    job = lambda *rows: frame([(ids[c], t, u, None) for c, t, u in rows], made).withColumn("discovered_at", NOW)
    assert r.upsert_jobs(job(("B", "one", "https://x.example/1?utm_source=a"), ("B", "two", "https://x.example/2/"), ("B", "again", "https://x.example/1#x"))).count() == 0
    lost = r.upsert_jobs(frame([("nobody", "t", "https://x.example/9", None)], made))
    assert [x["title"] for x in lost.collect()] == ["t"] and r.table("jobs").count() == 2
    jobs = {x["canonical_url"]: x for x in r.table("jobs").collect()}
    one, two = jobs["https://x.example/1"], jobs["https://x.example/2"]
    assert (one["title"], one["applied"], one["aggregator_name"]) == ("again", False, "")
    assert r.job_url_exists("https://x.example/2?utm_medium=q") and not r.job_url_exists("https://x.example/3")
    r.enqueue(frame([(one["id"], "u", "e1"), (two["id"], "u", "e2")], "job_id string, url string, last_error string").withColumn("retry_after", NOW), NOW)
    r.enqueue(frame([(one["id"], "u", "e3")], "job_id string, url string, last_error string").withColumn("retry_after", LATER), LATER)
    q = {x["job_id"]: x for x in r.table("queue").collect()}
    assert (q[one["id"]]["last_error"], str(q[one["id"]]["created_at"]), str(q[one["id"]]["retry_after"])) == ("e3", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert [x["job_id"] for x in r.due(NOW).collect()] == [two["id"]]
    r.postpone(two["id"], LATER)
    assert r.due(NOW).count() == 0 and r.due(LATER).count() == 2
    assert r.apply_jobs([one["id"], "none"], LATER) == 1 and r.apply_jobs([], LATER) == 0
    assert [x["id"] for x in r.jobs(R.JobQuery(hide_applied=True)).collect()] == [two["id"]]
    assert r.ban_jobs([two["id"]]) == 1 and r.jobs_page(R.JobQuery())[1] == 1
    assert [x["title"] for x in r.jobs_by_ids([two["id"]]).collect()] == ["two"] and r.jobs_by_ids([]).count() == 0
    assert r.delete_jobs([two["id"]]) == 1 and [x["job_id"] for x in r.table("queue").collect()] == [one["id"]]
    r.dequeue(one["id"])
    assert r.table("queue").count() == 0
    r.close()


def test_migration_adds_columns_and_loses_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "r"))
    store.write("jobs", spark.createDataFrame([("1", "t")], "id string, title string"))
    row = repo.Repo(spark, str(tmp_path / "r")).table("jobs").first()
    assert (row["id"], row["title"], row["banned"], row["location"]) == ("1", "t", False, None)
    with pytest.raises(ValueError, match="own"):
        repo.migrate(spark.createDataFrame([("1", 2)], "id string, own int"), repo.JOBS)


def test_json_file(spark, tmp_path):
    repo.write_json(spark, str(tmp_path / "x.json"), {"a": [1, "é"]})
    text = (tmp_path / "x.json").read_text()
    assert json.loads(text) == {"a": [1, "é"]} and "\n  " in text


def test_client_waits_for_its_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    client = fetch.Client(rate=2, burst=3, sleep=sleep, clock=lambda: now[0])
    asked = []
    for address, wait in client.in_turn([*["https://A.example/x"] * 5, "https://b.example/", None, *["https://a.example/y"] * 1]):
        wait() if address else None
        asked.append((address, now[0]))
    assert slept == [0.5, 0.5, 0.5] and sorted(t for a, t in asked if a and "a.example" in a.lower()) == [0, 0, 0, 0.5, 1.0, 1.5]
    assert dict(asked)["https://b.example/"] == 0 and dict(asked)[None] == 0  # others go on meanwhile


def test_client_keeps_a_host_to_its_rate_across_windows(monkeypatch):
    monkeypatch.setattr(fetch, "WINDOW", 2)
    now, times = [0.0], []

    def sleep(s):
        now[0] += s

    client = fetch.Client(rate=10, burst=2, sleep=sleep, clock=lambda: now[0])
    for _, wait in client.in_turn(f"https://a.example/{k}" for k in range(50)):
        wait()
        times.append(now[0])
    for k in range(len(times)):  # never more than burst + rate x time
        assert sum(times[k] <= t <= times[k] + 1 + 1e-9 for t in times) <= 12
    assert abs(times[-1] - 4.8) < 1e-6


def test_client_pauses():
    client = fetch.Client(chance=lambda: 0.5)
    assert [client.pause(n, {}) for n in (1, 2, 5)] == [0.1, 0.2, 1.0] and client.pause(1, {"retry-After": " 3 "}) == 3.1
    at = fetch.datetime(2024, 1, 1, tzinfo=fetch.timezone.utc)
    assert [fetch.asked_seconds(v, at) for v in ("", "-1", "x", "0", "Mon, 01 Jan 2024 00:05:00 GMT", "Mon, 01 Jan 2024 00:10:00 GMT")] == [0, 0, 0, 0, 300, 0]


def test_a_timeout_is_not_tried_again():
    def late(u):
        raise TimeoutError("slow")

    assert fetch.one("https://a.example", late, fetch.Client(), lambda: None) == ("https://a.example", None, [], None, 1, "context deadline exceeded")


def test_pages_source(spark, tmp_path):
    rows = [(f"https://h{k % 7}.example.com/{'fr/' if k % 5 == 0 else ''}{k}{'#x' if k % 11 == 0 else ''}",) for k in range(200)] + [(None,), (" ",), ("https://blog.x.example/1",), ("https://h1.example.com/1",)]
    datasource.plan(spark.createDataFrame(rows, "url string"), str(tmp_path / "a"), 4)
    host = "lower(regexp_extract(url, '//([^/]*)', 1))"
    at = spark.read.parquet(str(tmp_path / "a")).where("url is not null").selectExpr(f"{host} AS h", "bucket").distinct()
    assert at.groupBy("h").count().where("count > 1").count() == 0 and at.select("bucket").distinct().count() > 1  # a host's addresses lie in one part
    df = datasource.read(spark, str(tmp_path / "a"), "harvest.plans.crawls:Answers", rate=1e6, attempts=2, least_ms=0)
    assert df.rdd.getNumPartitions() == len(list((tmp_path / "a").glob("bucket=*")))
    got = df.collect()
    assert len(got) == len(rows)
    by = {r.url: r for r in got}
    assert (by[None].error, by["https://blog.x.example/1"].error, by["https://blog.x.example/1"].attempts) == ("no address", "no route", 2)
    assert all((r.status, r.error) == ((404, "http 404") if "#" in r.url else (200, None)) for r in got if r.url and "//h" in r.url)
    assert sum(r.url == "https://h1.example.com/1" for r in got) == 2
    datasource.plan(spark.createDataFrame([], "url string"), str(tmp_path / "b"), 4)
    assert datasource.read(spark, str(tmp_path / "b"), "harvest.plans.crawls:Answers").collect() == []


def test_fetch_brings_a_hosts_addresses_into_one_task(spark):
    from pyspark import TaskContext

    urls = spark.createDataFrame([(f"https://h{k % 5}.example/{k}",) for k in range(100)], "url string").repartition(8)
    got = fetch.fetch(urls, lambda u: (200, {}, str(TaskContext.get().partitionId())), fetch.Client(rate=1e6)).collect()
    assert len(got) == 100 and len({(r.url.split("/")[2], r.html) for r in got}) == 5


def test_fetch_of_nothing_and_blank(spark):
    got = fetch.fetch(spark.createDataFrame([(None,), (" ",)], "url string"), lambda u: (200, {}, u), fetch.Client())
    assert [(r["status"], r["error"], r["attempts"]) for r in got.collect()] == [(None, "no address", 0)] * 2
    assert fetch.fetch(spark.createDataFrame([], "url string"), lambda u: (200, {}, u)).count() == 0


@pytest.fixture
def feed_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [[("a", 1, "x", 1), ("b", 1, "x", 2), ("a", 2, "y", 3)], [("a", 3, "z", 4), ("c", 1, "z", 5), ("c", 2, "w", 6)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "k string, v int, kept string, pos int").coalesce(1).write.mode("append").json(folder)
    return folder


def test_feed_stream_merges_duplicated_and_replayed_batches(spark, tmp_path, feed_files):
    store, seen = Store(spark, str(tmp_path / "s")), []
    run = lambda check: feed.run_feed(feed.replay(spark, feed_files, "k string, v int, kept string, pos int"), store, "t", ["k"], ["v"], order="pos", checkpoint=str(tmp_path / check), on_new=lambda df: seen.extend(r["k"] for r in df.collect())).awaitTermination()
    run("one")
    want = [("a", 3, "x"), ("b", 1, "x"), ("c", 2, "z")]
    assert sorted(tuple(r) for r in store.read("t").collect()) == want and sorted(seen) == ["a", "b", "c"]
    run("two")  # all of it once more
    assert sorted(tuple(r) for r in store.read("t").collect()) == want and sorted(seen) == ["a", "b", "c"]


def test_recent_log_is_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for k in range(3):
        feed.keep_recent(store, "log", spark.range(10 * k, 10 * k + 10), "id", 12)
    assert sorted(r["id"] for r in store.read("log").collect()) == list(range(18, 30))
