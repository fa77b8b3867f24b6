"""Counters from an event log: sums by name, derived ratios, the exposition, timers and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import ratio

# The counters, the sums of milliseconds that timers add to, and the names of the exposed series.
COUNTERS = [
    "http_requests_total", "http_request_duration_ms", "http_errors_total",
    "jobs_scraped_total", "jobs_processed_total", "scraping_duration_ms",
    "db_queries_total", "db_query_duration_ms", "db_errors_total",
    "memory_allocated_bytes", "memory_freed_bytes", "object_pool_hits", "object_pool_misses",
    "cache_hits", "cache_misses", "panics_recovered",
]
TIMERS = {"http": "http_request_duration_ms", "scraping": "scraping_duration_ms", "db": "db_query_duration_ms"}
SERIES = {
    "http_requests_total": "http_requests_total", "http_errors_total": "http_errors_total", "http_request_duration_ms": "http_request_duration_ms_total",
    "jobs_scraped_total": "jobs_scraped_total", "jobs_processed_total": "jobs_processed_total", "scraping_duration_ms": "jobs_scraping_duration_ms_total",
    "db_queries_total": "db_queries_total", "db_errors_total": "db_errors_total", "db_query_duration_ms": "db_query_duration_ms_total",
    "memory_allocated_bytes": "memory_allocated_bytes_total", "memory_freed_bytes": "memory_freed_bytes_total", "object_pool_hits": "objectpool_hits_total", "object_pool_misses": "objectpool_misses_total",
    "cache_hits": "cache_hits_total", "cache_misses": "cache_misses_total", "panics_recovered": "runtime_panics_recovered_total", "uptime_seconds": "process_uptime_seconds",
}


def elapsed(kind: Column, started: Column, ended: Column) -> Column:
    """struct(name, amount) of a timer: its milliseconds for one of three sums; null for another kind."""
    name = F
    for k, counter in TIMERS.items():
        name = name.when(kind == k, counter)
    name = name.otherwise(F.lit(None).cast("string"))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), (F.unix_millis(ended) - F.unix_millis(started)).alias("amount")))


def since_reset(events: DataFrame, resets: DataFrame, at: str = "at") -> DataFrame:
    """Events after the last reset: a reset deletes nothing, it begins an epoch."""
    last = resets.agg(F.max(at).alias("_reset"))  # one row
    return events.join(F.broadcast(last), F.col("_reset").isNull() | (F.col(at) > F.col("_reset"))).drop("_reset")


def snapshot(events: DataFrame, uptime: Column) -> DataFrame:
    """One row: uptime_seconds, all counters as sums of (name, amount), and seven ratios, 0 where there is nothing to divide by."""
    got = events.agg(*(F.coalesce(F.sum(F.when(F.col("name") == c, F.col("amount"))), F.lit(0)).cast("long").alias(c) for c in COUNTERS))
    c, up = F.col, uptime.cast("double")
    return got.select(
        F.floor(up).alias("uptime_seconds"), *COUNTERS,
        ratio(c("http_requests_total"), up).alias("http_requests_per_second"), ratio(c("jobs_scraped_total"), up).alias("jobs_scraped_per_second"),
        ratio(c("cache_hits"), c("cache_hits") + c("cache_misses")).alias("cache_hit_rate"), ratio(c("object_pool_hits"), c("object_pool_hits") + c("object_pool_misses")).alias("object_pool_hit_rate"),
        ratio(c("http_request_duration_ms"), c("http_requests_total")).alias("average_http_duration_ms"), ratio(c("scraping_duration_ms"), c("jobs_scraped_total")).alias("average_scraping_duration_ms"),
        ratio(c("db_query_duration_ms"), c("db_queries_total")).alias("average_db_duration_ms"),
    )


def exposition(snap: DataFrame, prefix: str = "app_") -> DataFrame:
    """(series, kind, value) of the seventeen series, their names after a prefix; uptime is a gauge, all others are counters."""
    names = list(SERIES)
    long = snap.select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], names, "name", "value")
    series = F.create_map(*[F.lit(x) for name, series in SERIES.items() for x in (name, prefix + series)])
    return long.select(series[F.col("name")].alias("series"), F.when(F.col("name") == "uptime_seconds", "gauge").otherwise("counter").alias("kind"), "value")


def rates(samples: DataFrame, seconds: int = 300, stretches: int = 20) -> DataFrame:
    """(name, bucket, rate) of counters (name, at, value): by bucket of time, what the counter gained since the last sample of
    the bucket before (or its own first, where that has none), per second.

    A value below the one before it means that the counter began again at 0, so all of it is gain. Samples of one time are
    taken by value. Gains are added up in two levels, within short stretches of time and then over the stretches of a bucket, which
    a step from one's last sample to the next one's first joins, so that no task holds a counter's whole log or bucket.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    own = samples.where("at is not null and value is not null").select("name", "value", micros.alias("_t"))
    own = own.withColumn("bucket", F.floor(F.col("_t") / (seconds * 1_000_000)) * seconds).withColumn("_s", F.floor(F.col("_t") * stretches / (seconds * 1_000_000)))
    gain = lambda now, before: F.when(before.isNull(), 0).when(now >= before, now - before).otherwise(now)
    within = Window.partitionBy("name", "bucket", "_s").orderBy("_t", "value")
    steps = own.withColumn("_gain", gain(F.col("value"), F.lag("value").over(within)))
    order = F.struct("_t", "value")
    parts = steps.groupBy("name", "bucket", "_s").agg(F.sum("_gain").alias("_gain"), F.min(order)["value"].alias("first"), F.max(order)["value"].alias("last"))
    across = Window.partitionBy("name", "bucket").orderBy("_s")
    parts = parts.withColumn("_gain", F.col("_gain") + gain(F.col("first"), F.lag("last").over(across)))
    whole = parts.groupBy("name", "bucket").agg(F.sum("_gain").alias("_gain"), F.min_by("first", "_s").alias("first"), F.max_by("last", "_s").alias("last"))
    before = whole.select("name", (F.col("bucket") + seconds).alias("bucket"), F.col("last").alias("before"))
    got = whole.join(before, ["name", "bucket"], "left")
    return got.select("name", "bucket", ((F.col("_gain") + gain(F.col("first"), F.col("before"))) / F.lit(float(seconds))).alias("rate"))
