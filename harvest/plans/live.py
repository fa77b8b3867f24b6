"""Queries that run a stream over a table to its end: the scan's new postings, and the retry queue on timers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import url
from ..sources import crawl
from ..streaming import live
from .common import jobs, table
from .derived import pick
from .pipeline import O as SCANNED
from .pipeline import found
from .whole import _RUN, RULES

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


def _folder(spark) -> str:
    return f"{crawl.scratch(spark)}/{uuid.uuid4().hex}"


@query(SCANNED["scan_pipeline"])
def scan_live(spark, d):
    """The scan as a stream of pages: what the store lacks, each address once."""
    stored = table(spark, d, "pages")
    pages = spark.readStream.schema(stored.schema).parquet(f"{d}/pages.parque[t]")  # a pattern: a stream takes no single file
    got = live.accepted(found(pages, RULES), stored.select(url.canonical_checked(F.col("url")).alias("target")), "target", ["page_id", "pos"])
    return live.run_to_end(got.select("target", "title", "company"), _folder(spark))


def _log(spark, d):
    """Events as queue entries, orders as their jobs, outcomes of the next attempts, and one later entry that moves the time on."""
    e, none = table(spark, d, "events"), lambda kind: F.lit(None).cast(kind)
    start, now = (F.lit(x).cast("timestamp") for x in ("2023-12-31", "2024-01-20"))
    row = lambda df, at, kind, until=none("timestamp"), applied=none("boolean"), error=none("string"): df.select("job_id", at.alias("at"), F.lit(kind).alias("kind"), until.alias("retry_after"), applied.alias("applied"), error.alias("error"))
    queue = row(e.select(F.col("event_id").alias("job_id"), "ts"), start, "enqueue", F.col("ts").cast("timestamp"))
    known = row(jobs(spark, d).select(F.col("id").alias("job_id"), F.col("applied").alias("a")), start, "job", applied=F.col("a"))
    tried = e.where("event_id % 5 <> 4").select(F.col("event_id").alias("job_id"), pick("event_id", ["", "got 429 from x", "bad form", "timeout", ""]).alias("e"))
    tick = row(spark.range(1).select(F.lit(-1).cast("long").alias("job_id")), now, "job", applied=F.lit(True))
    return queue.unionByName(known).unionByName(row(tried, start, "outcome", error=F.col("e"))).unionByName(tick)


@query(f"""SELECT event_id AS job_id, 'queued' AS action, ts AS retry_after FROM events UNION ALL
SELECT job_id, action, CASE action WHEN 'requeue' THEN TIMESTAMP '2024-01-20 02:00:00' WHEN 'keep' THEN ts END FROM ({_RUN}) WHERE action <> 'later'""")
def retry_timers(spark, d):
    """Every change of the queue up to 20 January."""
    folder = _folder(spark)
    log = _log(spark, d)
    log.write.parquet(f"{folder}/log")
    changes = live.retries(spark.readStream.schema(log.schema).parquet(f"{folder}/log"))
    return live.run_to_end(changes, folder).select("job_id", "action", "retry_after")
