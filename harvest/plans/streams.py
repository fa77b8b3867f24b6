"""Queries of metrics, ordered histories, flow control and policies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from ..streaming.folds import Breaker, TokenBucket, fold
from .common import literal, table, values

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_COUNTS = "count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS duration_ms, count(*) FILTER (event_type = 'click') AS cache_hits, count(*) FILTER (event_type = 'view') AS cache_misses"


def _snapshot(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    return e.agg(F.count("*").alias("requests"), F.count_if(kind == "error").alias("errors"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("duration_ms"), F.count_if(kind == "click").alias("cache_hits"), F.count_if(kind == "view").alias("cache_misses"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) / 300.0::DOUBLE AS rate FROM events")
def rate_5m(spark, d):
    return R.rate(table(spark, d, "events"), ["event_type"], "ts").select("event_id", "rate")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 100")
def history_100(spark, d):
    return R.recent(table(spark, d, "events").select("event_id", "ts"), "ts", 100)


@query("""SELECT e.event_id, coalesce(e.ts <= s.last + INTERVAL 2 HOUR, FALSE) AS hit FROM events e LEFT JOIN LATERAL (SELECT max(p.ts) AS last FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) s ON TRUE WHERE e.event_type <> 'purchase'""")
def ttl_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    got = e.withColumn("last", last).where("event_type <> 'purchase'")
    return got.select("event_id", F.coalesce(F.col("ts") <= F.col("last") + F.expr("INTERVAL 2 HOURS"), F.lit(False)).alias("hit"))


def _log(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") != "error").alias("ok"))


_STEPS = "e AS (SELECT event_id, user_id, epoch_ms(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events)"
_GAINED = "least(2, r.tokens + (e.t - r.last) // 3600000)"


@query(f"""WITH RECURSIVE {_STEPS},
r AS (SELECT user_id, event_id, n, t AS last, 1 AS tokens, TRUE AS allowed FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.last >= 3600000 THEN e.t ELSE r.last END, greatest(0, {_GAINED} - 1), {_GAINED} > 0 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, allowed FROM r""")
def token_bucket(spark, d):
    return fold(_log(spark, d), TokenBucket(limit=2, interval_ms=3_600_000), "user_id", "ts_ms", "ok", "event_id")


@query(f"""WITH RECURSIVE {_STEPS},
r AS (SELECT user_id, event_id, n, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failed, CASE WHEN ok THEN 0 ELSE t END AS since, 0 AS good, TRUE AS admitted FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n,
  CASE WHEN now = 'open' THEN 'open' WHEN NOT ok AND failed + 1 >= 2 THEN 'open' WHEN ok AND now = 'half-open' AND (CASE WHEN woke THEN 0 ELSE good END) + 1 >= 3 THEN 'closed' ELSE now END,
  CASE WHEN now = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN now = 'open' OR ok THEN since ELSE t END,
  CASE WHEN now <> 'half-open' THEN good ELSE (CASE WHEN woke THEN 0 ELSE good END) + CASE WHEN ok THEN 1 ELSE 0 END END, now <> 'open'
FROM (SELECT e.user_id, e.event_id, e.n, e.t, e.ok, r.failed, r.since, r.good, r.state = 'open' AND e.t - r.since > 3600000 AS woke,
  CASE WHEN r.state = 'open' AND e.t - r.since > 3600000 THEN 'half-open' ELSE r.state END AS now FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, state, admitted FROM r""")
def breaker_states(spark, d):
    return fold(_log(spark, d), Breaker(failures=2, timeout_ms=3_600_000, probes=3), "user_id", "ts_ms", "ok", "event_id")


POLICY = [(1, 500, True, 200.0), (2, 404, False, 400.0), (5, 429, True, 2000.0), (3, 503, True, 800.0)]


@query(f"SELECT attempt, status, retry, most_ms FROM {values('attempt, status, retry, most_ms', POLICY)}")
def retry_policy(spark, d):
    df = literal(spark, "attempt, status, r, m", POLICY)
    return df.select("attempt", "status", F.col("status").isin(408, 429, 500, 502, 503, 504).alias("retry"), F.least(F.lit(2000.0), F.lit(200.0) * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("most_ms"))


ERRORS = [("got 429", True, True), ("Rate Limit hit", True, False), ("connection refused", False, True), ("bad input", False, False)]


@query(f"SELECT e, limited FROM {values('e, limited', [(a, b) for a, b, _ in ERRORS])}")
def error_classes(spark, d):
    return literal(spark, "e, l, r", ERRORS).select("e", F.lower("e").rlike("429|rate limit|too many requests").alias("limited"))


@query("SELECT event_id, 'Network' AS label, concat('user ', user_id) AS who FROM events WHERE event_type = 'error'")
def error_structs(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    labels = F.create_map(F.lit("error"), F.lit("Network"), F.lit("click"), F.lit("Unknown"))
    context = F.map_concat(F.create_map(F.lit("who"), F.concat(F.lit("user "), F.col("user_id").cast("string"))), F.create_map(F.lit("at"), F.col("ts").cast("string")))
    return e.select("event_id", labels[F.col("event_type")].alias("label"), context["who"].alias("who"))
