"""Streams with keyed state against their batch forms: rows accepted once, and the retry queue on timers."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from harvest.operators import relational as R  # noqa: E402
from harvest.streaming import live  # noqa: E402

DAY = datetime.datetime(2024, 1, 1)


def hour(h: float) -> datetime.datetime:
    return DAY + datetime.timedelta(hours=h)


def parts_of(spark, folder, schema, parts):
    """A stream that gets the parts one after the other."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return lambda upto: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{'{' + ','.join(map(str, range(upto))) + '}'}")


FOUND = "page long, pos int, url string, title string"


def test_accepted_equals_the_batch_and_comes_once(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(10 * k + p, i, rng.choice([None, *(f"u{n}" for n in range(25))]), f"t{k}.{p}.{i}") for p in range(4) for i in range(5)] for k in range(3)]
    stored = spark.createDataFrame([("u1",), ("u2",), ("u1",), (None,), ("other",)], "url string")
    stream = parts_of(spark, str(tmp_path / "in"), FOUND, parts)
    run = lambda upto, folder="out": live.run_to_end(live.accepted(stream(upto), stored, "url", ["page", "pos"]), str(tmp_path / folder)).collect()
    rows = spark.createDataFrame([r for p in parts for r in p], FOUND).where("url is not null")
    want = sorted(tuple(r) for r in R.first_by(R.having(rows, stored.distinct(), "url", there=False), ["url"], ["page", "pos"]).select("page", "pos", "url", "title").collect())
    assert sorted(map(tuple, run(3))) == want and len(want) > 15
    assert sorted(map(tuple, run(3))) == want  # the query goes on from its checkpoint: nothing new
    spark.createDataFrame([*parts[0], (99, 0, "fresh", "n"), (99, 1, "fresh", "m")], FOUND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "2"))
    assert sorted(map(tuple, run(3))) == sorted([*want, (99, 0, "fresh", "n")])  # old rows come again, with one that is new


def test_accepted_of_nothing(spark, tmp_path):
    stream = parts_of(spark, str(tmp_path / "in"), FOUND, [[(1, 0, None, "x")]])
    none = spark.createDataFrame([], "url string")
    assert live.run_to_end(live.accepted(stream(1), none, "url", ["page", "pos"]), str(tmp_path / "out")).collect() == []


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    schema = "at timestamp, url string, n int"
    parts = [[(hour(0), "a", 1)], [(hour(1), "a", 2), (hour(1), "b", 3)], [(hour(30), "z", 4)], [(hour(31), "a", 5)]]
    stream = parts_of(spark, str(tmp_path / "in"), schema, parts)
    none = spark.createDataFrame([], "url string")
    for k in range(1, 5):
        got = live.run_to_end(live.accepted(stream(k).withWatermark("at", "0 seconds"), none, "url", ["n"], at="at", keep_ms=24 * 3_600_000), str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 5]


LOG = "job_id long, at timestamp, kind string, retry_after timestamp, applied boolean, error string"


def test_timers_equal_runs_of_the_batch_worker(spark, tmp_path):
    """At each point that the watermark reaches, the stream has worked what retry_run works at that time."""
    rng = random.Random(2)
    jobs = {j: rng.random() < 0.2 for j in range(30) if j % 6}
    ends = {(j, k): rng.choice([None, "", "got 429", "Too Many requests", "bad form"]) for j in range(30) for k in range(4)}
    due = {j: hour(rng.choice([0.5, 1.5, 2.5, 6])) for j in range(30)}
    points = [hour(1), hour(3), hour(7), hour(8)]
    row = lambda j, at, kind, until=None, applied=None, error=None: (j, at, kind, until, applied, error)
    parts = [[row(j, hour(0), "enqueue", until=t) for j, t in due.items()] + [row(j, hour(0), "job", applied=a) for j, a in jobs.items()]]
    for k, at in enumerate(points):
        parts[k] += [row(j, at, "outcome", error=e) for (j, n), e in ends.items() if n == k and e is not None] + [row(-1, at, "job", applied=True)]
        parts.append([])
    stream = parts_of(spark, str(tmp_path / "in"), LOG, parts[:-1])

    queue, actions = spark.createDataFrame(list(due.items()), "job_id long, retry_after timestamp"), []
    known = dict(jobs)
    waiting: dict[int, str] = {}
    ready = dict(due)  # a kept entry is due again at the next tick
    for k, at in enumerate(points):
        waiting |= {j: e for (j, n), e in ends.items() if n == k and e is not None}
        left = {r.job_id: r.retry_after for r in queue.collect()}
        held = [(j, t) for j, t in left.items() if ready[j] > at]
        table = spark.createDataFrame([(j, ready[j]) for j in left if ready[j] <= at], "job_id long, retry_after timestamp")
        people = spark.createDataFrame(list(known.items()), "id long, applied boolean")
        done, _ = R.retry_run(table, people, spark.createDataFrame(list(waiting.items()), "job_id long, error string"), F.lit(at), 2)
        got = {r.job_id: r.action for r in done.collect()}
        actions += got.items()
        for j, a in got.items():
            waiting.pop(j, None)
            if a == "requeue":
                left[j] = ready[j] = at + datetime.timedelta(hours=2)
            elif a == "keep":
                ready[j] = at + datetime.timedelta(minutes=30)
            elif a == "applied":
                known[j] = True
        queue = spark.createDataFrame(held + [(j, left[j]) for j, a in got.items() if a in ("keep", "requeue")], "job_id long, retry_after timestamp")

    changes = live.run_to_end(live.retries(stream(len(points))), str(tmp_path / "out"))
    rows = changes.collect()
    assert sorted((r.job_id, r.action) for r in rows if r.action != "queued") == sorted(actions)
    assert {"dequeue_missing", "dequeue_applied", "keep", "requeue", "applied"} == {a for _, a in actions}
    assert sorted((r.job_id, r.retry_after) for r in live.queue_of(changes).collect()) == sorted((r.job_id, r.retry_after) for r in queue.collect())
    assert sum(r.action == "queued" for r in rows) == 30


def test_many_jobs_share_few_states(spark, tmp_path):
    """Thousands of jobs take a call and a value of state for each bucket, not for each job."""
    n, row = 3000, lambda j, at, kind, until=None, applied=None, error=None: (f"j{j}", at, kind, until, applied, error)
    first = [r for j in range(n) for r in (row(j, hour(0), "enqueue", until=hour(1 + j % 3)), row(j, hour(0), "outcome", error=["", "got 429", "bad form"][j % 5 % 3])) if r[2] == "enqueue" or j % 5 < 3]
    first += [row(j, hour(0), "job", applied=j % 7 == 0) for j in range(n) if j % 11]
    parts = [[*first, row(-1, hour(2), "job", applied=True)], [row(-1, hour(2.1), "enqueue", until=hour(0.5))]]  # the last one's time has passed
    stream = parts_of(spark, str(tmp_path / "in"), LOG.replace("job_id long", "job_id string"), parts)
    with live.on_disk(spark):
        query = live.retries(stream(2), buckets=8).writeStream.outputMode("append").format("memory").queryName("few_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 8
    got = {r.job_id: (r.action, r.retry_after, r.at) for r in spark.table("few_states").where("action <> 'queued'").collect()}
    ends = lambda j: ("keep", hour(1 + j % 3)) if j % 5 > 2 else (("applied", None), ("requeue", hour(4)), ("keep", hour(1 + j % 3)))[j % 5]
    want = {f"j{j}": ("dequeue_missing", None) if j % 11 == 0 else ("dequeue_applied", None) if j % 7 == 0 else ends(j) for j in range(n) if 1 + j % 3 <= 2}
    assert got == {j: (*x, hour(2)) for j, x in want.items()} | {"j-1": ("dequeue_applied", None, hour(2))}
    assert spark.table("few_states").where("action = 'queued'").count() == n + 1


def test_provider_is_put_back(spark):
    before = spark.conf.get(live._PROVIDER, None)
    with live.on_disk(spark):
        assert "RocksDB" in spark.conf.get(live._PROVIDER)
    assert spark.conf.get(live._PROVIDER, None) == before
