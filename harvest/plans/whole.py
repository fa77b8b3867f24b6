"""Queries of the library's operators on stored, fetched and counted things: each runs the operator over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score, text, url
from ..operators import metrics as M
from ..operators import relational as R
from ..sources import crawl, fetch, links
from ..streaming.folds import TtlCache, fold
from .common import ASCII, COMPANIES, JOBS, companies, jobs, literal, queue, table
from .derived import chosen, pick, quoted, say
from .store import BAD, _AUTH, _FIRST, _FOUND, _HOST, _PATH, _SCHEME, ANCHORS

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# --- the store


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_name")
def list_active_sorted(spark, d):
    return R.active_sorted(table(spark, d, "supplier"), F.col("s_acctbal") > 0, "s_name").select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey IN (1, 3, 7, 999, 99999999)")
def multi_get_projection(spark, d):
    o = table(spark, d, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderdate"]
    return R.multi_get(o, [1, 3, 7, 999, 99999999], "o_orderkey", columns).unionByName(R.multi_get(o, [], "o_orderkey", columns))


@query("SELECT o_custkey, count(*) AS total, CAST(floor(o_custkey % 7 * 25 / 25) + 1 AS BIGINT) AS page, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages, count(*) > o_custkey % 7 * 25 + 25 AS has_next FROM orders GROUP BY o_custkey")
def page_math(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    return g.select("o_custkey", "total", R.page_info(F.col("total"), F.lit(25), F.col("o_custkey") % 7 * 25).alias("x")).select("o_custkey", "total", "x.page", "x.pages", "x.has_next")


@query("""SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.event_type, s.event_type) AS event_type, CASE WHEN s.user_id IS NOT NULL THEN s.value ELSE t.value END AS value, coalesce(t.id, s.id) AS id
FROM (SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS id FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) t
FULL JOIN (SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS id FROM events WHERE event_id % 3 = 0 GROUP BY ALL) s ON t.user_id = s.user_id AND t.event_type = s.event_type""")
def upsert_job(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("id"), F.col("event_id").alias("pos"))
    stored = R.upsert(e.drop("pos").limit(0), e.where("id % 3 <> 0"), ["user_id", "event_type"], ["value"], order="pos")
    return R.upsert(stored, e.where("id % 3 = 0"), ["user_id", "event_type"], ["value"], order="pos")


@query("SELECT count(*) AS affected FROM orders WHERE o_orderkey % 9 = 0")
def rows_affected(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return R.affected(o, o.where("o_orderkey % 9 = 0"), "o_orderkey")


@query("SELECT event_id AS job_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS retry_after FROM events")
def queue_postpone(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("retry_after"))
    return R.postpone(q, q.where("job_id % 5 = 0"), F.lit("2024-02-01").cast("timestamp_ntz"))


@query("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id * 3)")
def exists_semi(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return R.having(table(spark, d, "pages").select("page_id"), docs, F.col("page_id") * 3 == F.col("doc_id"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def existing_anti(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return R.having(p, p.where("page_id % 2 = 0").select("url").distinct(), "url", there=False).select("page_id", "url")


@query(_FIRST.format(out="c_custkey", key="lower(trim(c_mktsegment)), lower(split_part(c_name, '00', 2))", order="c_custkey", src="customer"))
def dedupe_title_url(spark, d):
    c = table(spark, d, "customer").select("c_custkey", pick("c_custkey", [F.col("c_mktsegment"), say(" {c_mktsegment}\t"), F.lower("c_mktsegment")]).alias("title"), F.split_part("c_name", F.lit("00"), F.lit(2)).alias("url"))
    return R.by_title_and_url(c, ["c_custkey"]).select("c_custkey")


@query(_FIRST.format(out="doc_id", key="CASE WHEN doc_id % 7 = 0 THEN '' ELSE lower(trim(regexp_replace(text, '[\\s]+', ' ', 'g'))) END", order="doc_id", src="documents"))
def dedupe_normalized(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, pick("doc_id", [F.lit(" "), F.lit(None).cast("string")])).otherwise(F.col("text")).alias("title"), F.lit(None).cast("string").alias("url"))
    return R.by_normal_text(docs, ["doc_id"]).select("doc_id")


@query("SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def union_sources(spark, d):
    n, s, c = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    return R.named({"nation": (n, "n_name"), "supplier": (s, "s_name"), "customer": (c.where(F.lower(F.trim("c_mktsegment")) == "building"), "c_name")})


@query("SELECT p.page_id, coalesce(a.s_suppkey, b.s_suppkey) AS company_id FROM pages p LEFT JOIN supplier a ON a.s_suppkey = p.page_id * 2 LEFT JOIN supplier b ON b.s_suppkey = p.page_id WHERE coalesce(a.s_suppkey, b.s_suppkey) IS NOT NULL")
def resolve_company_chain(spark, d):
    p, s = table(spark, d, "pages").select("page_id", (F.col("page_id") * 2).alias("own")), table(spark, d, "supplier").select("s_suppkey")
    return R.first_key(p, [("own", s, "s_suppkey", "s_suppkey"), ("page_id", s, "s_suppkey", "s_suppkey")], "company_id").select("page_id", "company_id")


@query("SELECT event_id, left(sha256('company' || chr(31) || CASE WHEN user_id % 4 = 0 THEN 'Board' ELSE 'user ' || user_id END), 32) AS company_id FROM events WHERE user_id % 4 = 0 OR user_id % 3 <> 0 UNION ALL SELECT event_id, 'c' || user_id FROM events WHERE user_id % 4 <> 0 AND user_id % 3 = 0")
def lookup_or_create(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, say("user {user_id}")).otherwise("").alias("company"), say("https://x.example/{user_id}").alias("feed"))
    known = table(spark, d, "events").where("user_id % 3 = 0").select(say("c{user_id}").alias("id"), say("user {user_id}").alias("name"), F.lit("").alias("careers_url")).distinct()
    rows, _ = R.lookup_or_create(e, known, "company", F.lit("Board"), {"careers_url": F.col("feed")})
    return rows.select("event_id", F.col("id").alias("company_id"))


@query(f"""SELECT '{{"items":[' || coalesce(string_agg('{{"id":' || id || ',"company_name":"' || company_name || '"}}', ',' ORDER BY discovered_at DESC, id), '') || '],"total":' || any_value(total) || ',"limit":25,"offset":50}}' AS json
FROM (SELECT * FROM (SELECT j.id, j.discovered_at, c.name AS company_name, count(*) OVER () AS total {_FOUND} ORDER BY j.discovered_at DESC, j.id LIMIT 25 OFFSET 50))""")
def search_envelope(spark, d):
    q = R.JobQuery(limit=25, offset=50)
    found = R.search(jobs(spark, d), companies(spark, d), q)
    page = found.orderBy(F.desc("discovered_at"), "id").offset(q.offset).limit(q.limit).select("id", "company_name")
    return R.envelope(page, found.agg(F.count("*")), q.limit, q.offset)


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE user_id END AS id, CASE WHEN event_id % 4 IN (2, 3) THEN NULL ELSE event_type END AS action, event_id % 4 = 3 AS bad FROM events")
def request_decode(spark, d):
    body = pick("event_id", [F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("action"))), F.to_json(F.struct(F.col("event_type").alias("action"), F.lit(1).alias("other"), F.col("user_id").alias("id"))), F.to_json(F.struct(F.col("user_id").alias("id"))), F.lit("{bad")])
    return R.decode(table(spark, d, "events").select("event_id", body.alias("body")), "body", "id long, action string").drop("body")


@query("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"user_id":' || user_id || ',"id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark, d):
    return table(spark, d, "events").select("event_id", R.frame(F.col("event_type"), F.struct("user_id", F.col("event_id").alias("id"))).alias("frame"))


@query("SELECT o_orderkey AS job_id, concat_ws(chr(10), 'Dear ' || c_name || ',', CASE WHEN o_orderpriority LIKE '1%' THEN 'Urgent.' END, 'Order ' || o_orderkey) AS body FROM orders JOIN customer ON c_custkey = o_custkey")
def message_template(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("job_id"), R.message([say("Dear {c_name},"), F.when(F.col("o_orderpriority").like("1%"), "Urgent."), say("Order {o_orderkey}")]).alias("body"))


# --- applying and trying again


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS sent, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS waiting, greatest(0, count(*) - count(*) FILTER (o_orderstatus IN ('F', 'P') OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0))) AS queued FROM orders")
def apply_tally(spark, d):
    s = F.col("o_orderstatus")
    outcome = F.when(s == "F", "sent").when(s == "P", "failed").when((s == "O") & (F.col("o_orderkey") % 2 == 0), "waiting")
    return R.tally(table(spark, d, "orders").select(outcome.alias("outcome")), "outcome")


_ACTION = "CASE WHEN o.o_orderkey IS NULL THEN 'dequeue_missing' WHEN o.o_orderstatus = 'F' THEN 'dequeue_applied' WHEN e.event_id % 5 = 4 THEN 'keep' WHEN e.event_id % 5 = 0 THEN 'applied' WHEN e.event_id % 5 = 1 THEN 'requeue' ELSE 'keep' END"
_RUN = f"SELECT e.event_id AS job_id, e.ts, CASE WHEN e.ts > TIMESTAMP '2024-01-20' THEN 'later' ELSE {_ACTION} END AS action FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id"


def _retry(spark, d):
    e = table(spark, d, "events")
    q = e.select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("retry_after"))
    outcomes = e.where("event_id % 5 <> 4").select(F.col("event_id").alias("job_id"), pick("event_id", ["", "got 429 from x", "bad form", "timeout", ""]).alias("error"))
    return R.retry_run(q, jobs(spark, d), outcomes, F.lit("2024-01-20").cast("timestamp"), 2)


@query(f"SELECT job_id, action FROM ({_RUN}) WHERE action <> 'later'")
def retry_run(spark, d):
    return _retry(spark, d)[0]


@query(f"SELECT job_id, CASE WHEN action = 'requeue' THEN TIMESTAMP '2024-01-20 02:00:00' ELSE ts END AS retry_after FROM ({_RUN}) WHERE action IN ('later', 'keep', 'requeue')")
def retry_queue_after(spark, d):
    return _retry(spark, d)[1]


# --- feeds


@query("SELECT event_type AS feed, count(*) AS found, count(DISTINCT user_id) FILTER (user_id % 3 <> 0) AS new, count(DISTINCT user_id) FILTER (user_id % 3 = 0) AS updated FROM events GROUP BY event_type")
def poll_counts(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("feed"), "user_id")
    return R.poll_counts(e, e.where("user_id % 3 = 0").select("user_id"), "feed", ["user_id"])


@query("SELECT event_id FROM events ORDER BY ts DESC LIMIT 20")
def last_n(spark, d):
    return R.recent(table(spark, d, "events").select("event_id", "ts"), "ts", R.bounded_updates(1000)).select("event_id")


_TTL = """SELECT e.event_id, coalesce(epoch_ms(e.ts) <= s.last + 7200000, FALSE) AS hit FROM events e LEFT JOIN LATERAL (SELECT max(epoch_ms(p.ts)) AS last FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (epoch_ms(p.ts) < epoch_ms(e.ts) OR epoch_ms(p.ts) = epoch_ms(e.ts) AND p.event_id < e.event_id)) s ON TRUE"""


@query(_TTL)
def ttl_cache(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") == "purchase").alias("ok"))
    return fold(log, TtlCache(7_200_000), "user_id", "ts_ms", "ok", "event_id").select("event_id", "hit")


# --- counting


_PAIRS = [("click", "http_requests_total"), ("view", "cache_hits"), ("error", "http_errors_total"), ("purchase", "jobs_scraped_total")]


def _counted(spark, d):
    """Events as increments; those of errors also time a request, by the event's value as seconds."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    name = F.create_map(*[F.lit(x) for p in _PAIRS for x in p])[F.col("event_type")]
    ms = F.round(F.col("value") * 1000).cast("long")
    timed = M.elapsed(pick("event_id", ["http", "scraping", "db", "other"]), F.timestamp_millis(F.lit(0)), F.timestamp_millis(F.coalesce(ms, F.lit(0))))
    return e.select("at", name.alias("name"), F.lit(1).cast("long").alias("amount")).where("name is not null").unionByName(e.select("at", timed.alias("t")).where("t is not null").select("at", "t.name", "t.amount"))


_SINCE = "(SELECT *, CAST(round(coalesce(value, 0) * 1000) AS BIGINT) AS ms FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 1000 = 0))"
_MS = {c: f"CAST(coalesce(sum(ms) FILTER (event_id % 4 = {k}), 0) AS BIGINT)" for k, c in enumerate(M.TIMERS.values())}
_SUM = {c: _MS.get(c, next((f"count(*) FILTER (event_type = '{e}')" for e, n in _PAIRS if n == c), "CAST(0 AS BIGINT)")) for c in M.COUNTERS}
_RATIOS = [("http_requests_total", "3600.0", "http_requests_per_second"), ("jobs_scraped_total", "3600.0", "jobs_scraped_per_second"), ("cache_hits", "(cache_hits + cache_misses)", "cache_hit_rate"), ("object_pool_hits", "(object_pool_hits + object_pool_misses)", "object_pool_hit_rate"), ("http_request_duration_ms", "http_requests_total", "average_http_duration_ms"), ("scraping_duration_ms", "jobs_scraped_total", "average_scraping_duration_ms"), ("db_query_duration_ms", "db_queries_total", "average_db_duration_ms")]
_SNAP = f"(SELECT CAST(3600 AS BIGINT) AS uptime_seconds, {', '.join(f'{x} AS {c}' for c, x in _SUM.items())} FROM {_SINCE})"


def _snap(spark, d):
    resets = table(spark, d, "events").where("event_id % 1000 = 0").select(F.col("ts").cast("timestamp").alias("at"))
    return M.snapshot(M.since_reset(_counted(spark, d), resets), F.lit(3600.5))


@query(f"SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS {n}' for a, b, n in _RATIOS)} FROM {_SNAP}".replace("3600.0", "3600.5::DOUBLE"))
def metrics_snapshot(spark, d):
    return _snap(spark, d)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'app_{s}' AS series, '{'gauge' if c == 'uptime_seconds' else 'counter'}' AS kind, CAST({c} AS DOUBLE) AS value FROM {_SNAP}" for c, s in M.SERIES.items()) + ")")
def metrics_long(spark, d):
    return M.exposition(_snap(spark, d))


#: A counter that starts again after every 50 events.
_COUNTER = "event_id % 50 * 2 + 2"


@query(f"""WITH c AS (SELECT event_type AS name, ts, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS bucket, {_COUNTER} AS v FROM events),
s AS (SELECT *, lag(v) OVER w AS before, lag(bucket) OVER w AS since FROM c WINDOW w AS (PARTITION BY name ORDER BY ts, v))
SELECT name, bucket, CAST(sum(CASE WHEN since IS NULL OR since < bucket - 300 THEN 0 WHEN v >= before THEN v - before ELSE v END) AS DOUBLE) / 300.0::DOUBLE AS rate FROM s GROUP BY name, bucket""")
def counter_rates(spark, d):
    samples = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("ts").alias("at"), F.expr(_COUNTER).alias("value"))
    return M.rates(samples)


@query("SELECT user_id, count(*) AS done, CAST(floor(count(*) FILTER (event_type = 'view') * 100 / count(*)) AS BIGINT) AS percent FROM events GROUP BY user_id")
def scan_progress(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("done"), R.percent(F.count_if(F.col("event_type") == "view"), F.count("*")).alias("percent"))


@query("SELECT count(*) - count(DISTINCT event_type) AS hits, count(DISTINCT event_type) AS misses FROM events WHERE event_type <> ''")
def intern_stats(spark, d):
    return R.intern_stats(table(spark, d, "events"), "event_type")


@query("SELECT event_type AS cache, count(DISTINCT user_id) AS keys FROM events GROUP BY event_type")
def cache_sizes(spark, d):
    return R.cache_sizes(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT event_type, count(*) AS submitted, count(*) FILTER (value > 50) AS completed, count(*) FILTER (value IS NULL OR value <= 50) AS rejected FROM events GROUP BY event_type")
def pool_stats(spark, d):
    return R.pool_stats(table(spark, d, "events"), "event_type", F.col("value") > 50)


# --- pages and links


_WANTED = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 404 WHEN page_id % 4 = 3 THEN NULL ELSE 200 END AS status, CASE page_id % 4 WHEN 1 THEN 'http 404' WHEN 3 THEN 'no route' ELSE NULL END AS error, CASE page_id % 4 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END AS attempts, CASE WHEN page_id % 2 = 0 THEN 5 + length(CAST(page_id AS VARCHAR)) END AS bytes FROM pages")
def bulk_fetch(spark, d):
    client = fetch.Client(rate=1e9, sleep=_no_wait)
    got = fetch.fetch(table(spark, d, "pages").select(say("https://x.example/{page_id}").alias("url")), _Answers(), client)
    return got.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "status", "error", "attempts", F.length("html").cast("long").alias("bytes"))


def _no_wait(seconds: float) -> None:
    pass


class _Answers:
    """A getter without a network: by the number in the address a page, none, one that comes at the third try, or no route."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def __call__(self, address: str) -> tuple[int, dict[str, str], str]:
        n = int(address.rpartition("/")[2])
        self.asked[address] = self.asked.get(address, 0) + 1
        if n % 4 == 3:
            raise OSError("no route")
        if n % 4 == 2 and self.asked[address] < 3:
            return 503, {}, "busy"
        return (404, {}, "gone") if n % 4 == 1 else (200, {"Server": "x"}, f"page {n}")


@query("SELECT page_id, length(html) AS bytes FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def fetched_details(spark, d):
    p = table(spark, d, "pages")
    got = fetch.good(fetch.from_pages(p.select("url").distinct(), p.where("page_id % 3 = 0")))
    kept = R.having(p, got.select("url"), "url")
    return kept.select("page_id", F.length("html").cast("long").alias("bytes"))


_TEXT = "trim(replace(text, '&amp;', '&'))"


@query(f"SELECT page_id, pos, href, {_TEXT} AS text FROM {ANCHORS}")
def anchors(spark, d):
    return links.anchors(table(spark, d, "pages")).select("page_id", "pos", "href", "text")


@query("SELECT c_custkey, unnest(range(4)) AS pos, unnest(['/a' || c_custkey, '/b?x=1&y=2', '/c', '/d>e']) AS href, unnest([c_name || ' & co', '', 'deep ' || c_custkey, c_mktsegment]) AS text FROM customer")
def anchors_any_markup(spark, d):
    h = say('<!-- <a href="/no">no</a> --><A class="x>y" HREF=\'/a{c_custkey}\' >\n <b>{c_name}</b>  &amp; co</A><script>"<a href=/no>no</a>"</script><a href="/b?x=1&amp;y=2"><img src="i"></a><a name="no">no</a><p><a\nhref=/c><span>deep</span> <i>{c_custkey}</i></a><a data-href="/no" href="/d>e">{c_mktsegment}')
    return links.anchors(table(spark, d, "customer").select("c_custkey", h.alias("html"))).select("c_custkey", F.col("pos").cast("long").alias("pos"), "href", "text")


_HREF_OK = f"NOT (trim(href) = '' OR starts_with(href, '#') OR regexp_matches(href, '{BAD}'))"
_TARGET = f"{_SCHEME} || '://' || {_AUTH} || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(href, '/$', '') END"
_WORDS = "list_filter(regexp_split_to_array(lower(text || ' ' || target), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')"


def _scored(threshold: float, bad: str) -> str:
    hits = lambda words: f"len(list_filter(w, lambda x: x IN {words}))"
    share = "len(list_filter(['the', 'and', 'attion'], lambda g: list_contains(w, g))) / 3.0"
    value = f"greatest(0.0, least(1.0, 0.65 * {hits(chr(40) + chr(39) + 'the' + chr(39) + ',' + chr(39) + 'and' + chr(39) + ',' + chr(39) + 'attion' + chr(39) + chr(41))} / len(w) + 0.35 * {share}))"
    return f"{value} >= {threshold} AND NOT list_contains(w, '{bad}')"


RULES = links.LinkRules(["the", "and", "attion"], ["und"], 0.1, True)


@query(f"SELECT page_id, pos, CASE WHEN {_HREF_OK} AND href LIKE '/%' AND {_scored(0.1, 'und')} THEN target END AS target FROM (SELECT *, {_WORDS} AS w FROM (SELECT page_id, url, pos, href, {_TEXT} AS text, {_TARGET} AS target FROM {ANCHORS}))")
def link_decision(spark, d):
    a = links.anchors(table(spark, d, "pages"))
    return a.select("page_id", "pos", RULES.decide(F.col("text"), F.col("href"), F.col("url")).alias("target"))


@query(f"""SELECT page, title, url FROM (SELECT page, title, target AS url, row_number() OVER (PARTITION BY page, lower(target) ORDER BY pos) AS k FROM
(SELECT *, {_WORDS} AS w, text AS title FROM (SELECT url AS page, url, pos, href, {_TEXT} AS text, {_TARGET} AS target FROM {ANCHORS} QUALIFY row_number() OVER (PARTITION BY url, href ORDER BY pos) = 1))
WHERE {_HREF_OK} AND href LIKE '/%' AND {_scored(0.1, 'und')}) WHERE k = 1""")
def crawl_generic(spark, d):
    return links.crawl(table(spark, d, "pages").select("url", "html"), RULES)


@query("SELECT 'https://c.example/' || p_size AS url, 'https://www.comeet.com/jobs/acme/' || lower(p_brand_) || '/A1.23B' AS target FROM (SELECT DISTINCT p_size, replace(p_brand, '#', '-') AS p_brand_ FROM part)")
def ats_discover(spark, d):
    return _system(spark, d, False)


@query("SELECT 'https://www.comeet.com/jobs/acme/' || lower(replace(p_brand, '#', '-')) || '/A1.23B' AS target FROM part GROUP BY ALL")
def ats_discover_all(spark, d):
    return _system(spark, d, True).select("target")


def _system(spark, d, across: bool):
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    item = say('<a href="https://www.comeet.com/jobs/acme/{s}/A1.23B?utm_source={p_partkey}#x">{p_name}</a><a href="https://www.comeet.com/jobs/acme">all</a><a href="/jobs/acme/{s}/A1.23B">own</a>', s=slug)
    page = table(spark, d, "part").select("p_size", item.alias("i")).groupBy("p_size").agg(F.array_join(F.collect_list("i"), "").alias("html"))
    got = links.system_links(page.select(say("https://c.example/{p_size}").alias("url"), "html"), across)
    return got.select("url", "target")


@query("SELECT 'https://o.example/p' AS url, 'Career ' || s_name AS text, 'https://o.example/p/x/' || s_suppkey AS target FROM supplier")
def older_crawl(spark, d):
    item = say('<a href="/p/x/{s_suppkey}">Career {s_name}</a><a href="/p/x/{s_suppkey}"> CAREER {s_name}</a><a href="/q/job">job</a><a href="#">job</a><a href="/p/y">News</a>')
    page = table(spark, d, "supplier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("h")))), lambda x: x["h"]), "").alias("html"))
    return links.older_crawl(page.select(F.lit("https://o.example/p").alias("url"), "html")).select("url", "text", "target")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS u, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS n FROM orders),
r AS (SELECT u AS seed, u, 0 AS depth FROM e WHERE u NOT IN (SELECT n FROM e WHERE n IS NOT NULL) UNION ALL SELECT r.seed, e.n, r.depth + 1 FROM r JOIN e ON e.u = r.u WHERE e.n IS NOT NULL)
SELECT seed, u AS url, depth FROM r""")
def crawl_reach(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"))
    return crawl.reach(o, crawl.frontier(o))

