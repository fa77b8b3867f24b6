"""Queries of the store: search page, merges, deletes, deduplication, queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import relational as R
from ..sources import links
from .common import ASCII, COMPANIES, JOBS, QUEUE, companies, jobs, literal, queue, table, values

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_FOUND = f"FROM {JOBS} j JOIN {COMPANIES} c ON c.id = j.company_id WHERE (j.banned IS NULL OR NOT j.banned)"
_MATCH = " AND (" + " OR ".join(ASCII.format(c) + " LIKE '%building%'" for c in ("j.title", "j.description", "j.location", "c.name")) + ")"
BUILDING = R.JobQuery(q="BUILDING", hide_applied=True, limit=25, offset=50)


@query(f"SELECT p.*, q.retry_after FROM (SELECT j.*, c.name AS company_name {_FOUND}{_MATCH} AND NOT j.applied ORDER BY j.discovered_at DESC, j.id LIMIT 25 OFFSET 50) p LEFT JOIN {QUEUE} q ON q.job_id = p.id")
def search_page(spark, d):
    return R.page(jobs(spark, d), companies(spark, d), queue(spark, d), BUILDING)


@query(f"SELECT count(*) AS total {_FOUND}{_MATCH} AND NOT j.applied")
def search_total(spark, d):
    return R.search(jobs(spark, d), companies(spark, d), BUILDING).agg(F.count("*").alias("total"))


@query(f"SELECT j.id, j.company_id {_FOUND} AND j.company_id = 7")
def search_company(spark, d):
    return R.search(jobs(spark, d), companies(spark, d), R.JobQuery(company_id=7)).select("id", "company_id")


@query(f"SELECT doc_id FROM documents WHERE {ASCII.format('text')} LIKE '%the%'")
def search_like_ascii(spark, d):
    return table(spark, d, "documents").where(text.like_ascii(F.col("text"), "tHe")).select("doc_id")


@query(f"SELECT p_partkey, p_name FROM part WHERE {ASCII.format('p_name')} LIKE '%u_%t%'")
def search_like_wildcard(spark, d):
    return table(spark, d, "part").where(text.like_ascii(F.col("p_name"), "U_%T")).select("p_partkey", "p_name")


@query(f"SELECT j.id {_FOUND} ORDER BY j.discovered_at DESC, j.id LIMIT 25")
def search_limit_reset(spark, d):
    return R.page(jobs(spark, d), companies(spark, d), queue(spark, d), R.JobQuery(limit=1000, offset=-3)).select("id")


@query(f"SELECT id FROM {JOBS} WHERE banned = FALSE OR banned IS NULL")
def filter_or_null_flag(spark, d):
    return jobs(spark, d).where(~F.coalesce("banned", F.lit(False))).select("id")


@query("SELECT event_id AS job_id, ts AS retry_after FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id")
def due_queue(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("retry_after"))
    return R.due(q, F.lit("2024-01-10 00:00:00").cast("timestamp"))


_MERGED = """
WITH t AS (SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS id FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
s AS (SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS id FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.event_type, s.event_type) AS event_type, CASE WHEN s.user_id IS NOT NULL THEN s.value ELSE t.value END AS value, coalesce(t.id, s.id) AS id
FROM t FULL JOIN s ON t.user_id = s.user_id AND t.event_type = s.event_type"""


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 'new ' || c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0")
def upsert_company_by_name(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 5).alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), "c_acctbal")
    return R.upsert(c, changed.unionByName(new), ["c_name"], ["c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def upsert_company_by_id(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    s = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return R.upsert(c, s, ["c_custkey"], ["c_mktsegment"])


@query(f"SELECT id, applied OR id % 9 = 0 AS applied, CASE WHEN id % 9 = 0 THEN TIMESTAMP '2024-02-01' ELSE discovered_at END AS discovered_at FROM {JOBS}")
def update_applied(spark, d):
    j = jobs(spark, d).select("id", "applied", "discovered_at")
    return R.update_by(j, j.where("id % 9 = 0").select("id"), "id", {"applied": F.lit(True), "discovered_at": F.lit("2024-02-01").cast("timestamp")})


@query(f"SELECT id, CASE WHEN id % 13 = 0 THEN TRUE ELSE banned END AS banned FROM {JOBS}")
def soft_delete(spark, d):
    j = jobs(spark, d).select("id", "banned")
    return R.update_by(j, j.where("id % 13 = 0").select("id"), "id", {"banned": F.lit(True)})


@query("SELECT 'job' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'queue', count(*) FROM lineitem WHERE l_orderkey % 10 <> 0")
def hard_delete_cascade(spark, d):
    o, li = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    gone = o.where("id % 10 = 0")
    return R.delete_by(o, gone, "id").agg(F.lit("job").alias("kind"), F.count("*").alias("n")).unionByName(R.delete_by(li, gone, "id").agg(F.lit("queue").alias("kind"), F.count("*").alias("n")))


@query("SELECT event_id AS job_id, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts END AS retry_after, ts AS created_at FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ts + INTERVAL 2 HOUR, ts + INTERVAL 1 DAY FROM events WHERE event_id % 6 = 3")
def queue_enqueue(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("retry_after"), F.col("ts").alias("created_at"))
    new = e.where("job_id % 3 = 0").select("job_id", (F.col("retry_after") + F.expr("INTERVAL 2 HOURS")).alias("retry_after"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return R.upsert(e.where("job_id % 2 = 0"), new, ["job_id"], ["retry_after"])


@query("SELECT event_id AS job_id FROM events WHERE event_id <> 42")
def queue_dequeue(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"))
    return R.delete_by(e, e.where("job_id = 42"), "job_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def fk_rejects(spark, d):
    return R.rejects(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_custkey % 5 <> 0"), "o_custkey", "c_custkey")


_FIRST = "SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos FROM {src}) WHERE pos = 1"


_HOST = "lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''))"
_AUTH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def _canon(drop: str, path: str, front: str = f"{_SCHEME} || '://' || {_AUTH}") -> str:
    kept = f"array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT ({drop}))), '&')"
    return f"{front} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


_K = "lower(split_part(p, '=', 1))"
STORED = _canon(f"starts_with({_K}, 'utm_')", f"regexp_replace({_PATH}, '/+$', '')")
CHECKED = _canon(f"starts_with({_K}, 'utm_') OR {_K} IN ('gclid', 'fbclid')", f"CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/$', '') END")
STRIPPED = _canon(f"starts_with({_K}, 'utm_') OR {_K} IN ('gclid', 'fbclid')", _PATH)
LISTED = _canon(f"{_K} IN ({', '.join(repr(x) for x in url.TRACKING)})", _PATH)


@query(_FIRST.format(out="page_id, url", key=CHECKED, order="page_id", src="pages"))
def dedupe_canonical(spark, d):
    return R.first_by(table(spark, d, "pages").select("page_id", "url"), [url.canonical_checked(F.col("url"))], ["page_id"])


@query(_FIRST.format(out="page_id, url", key=f"lower({CHECKED})", order="page_id", src="pages"))
def dedupe_casefold_url(spark, d):
    return R.first_by(table(spark, d, "pages").select("page_id", "url"), [F.lower(url.canonical_checked(F.col("url")))], ["page_id"])


@query(_FIRST.format(out="p_partkey, p_name", key="trim(p_name)", order="p_partkey", src="(SELECT * FROM part WHERE trim(p_name) <> '')"))
def seed_first_wins(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name").where(F.trim("p_name") != "")
    return R.first_by(p, [F.trim("p_name")], ["p_partkey"])


@query("SELECT p_partkey, lower(trim(p_name)) AS first_word, len(list_filter(list_distinct(list_transform([p_name, p_brand, upper(p_brand), ' '], lambda x: lower(trim(x)))), lambda x: x <> '')) AS n FROM part")
def keyword_set(spark, d):
    k = text.keyword_set(F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_brand"), F.array(F.upper("p_brand"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", k[0].alias("first_word"), F.size(k).cast("long").alias("n"))


@query(f"SELECT page_id, {STORED} AS canonical FROM pages")
def url_canon_store(spark, d):
    return table(spark, d, "pages").select("page_id", url.canonical_stored(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {CHECKED} AS canonical FROM pages")
def url_canon_validator(spark, d):
    return table(spark, d, "pages").select("page_id", url.canonical_checked(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {LISTED} AS canonical FROM pages")
def url_canon_util(spark, d):
    return table(spark, d, "pages").select("page_id", url.canonical_listed(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {STRIPPED} AS canonical FROM pages")
def url_strip_tracking(spark, d):
    return table(spark, d, "pages").select("page_id", url.without_tracking(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_SCHEME} AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, contains({_HOST}, 'example.org') AS org, {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') AS net FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    h = url.host_of(u)
    net = F.exists(F.array(F.lit("example.net")), lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s)))
    return table(spark, d, "pages").select("page_id", url.scheme(u).alias("scheme"), h.alias("host"), url.path(u).alias("path"), url.query(u).alias("query"), F.contains(h, F.lit("example.org")).alias("org"), net.alias("net"))


ANCHORS = """(SELECT page_id, url, CAST(i AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text
FROM (SELECT page_id, url, unnest(l) AS a, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)))"""


@query(f"SELECT page_id, pos, {_SCHEME} || '://' || regexp_extract(url, '://([^/?#]*)', 1) || href AS resolved FROM {ANCHORS}")
def url_resolve(spark, d):
    return links.anchors(table(spark, d, "pages")).select("page_id", "pos", url.resolve(F.col("href"), F.col("url")).alias("resolved"))


@query(f"SELECT page_id, trim(translate(coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], ''), '-_', '  ')) AS title FROM pages")
def title_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", url.title_from(F.col("url")).alias("title"))


@query(f"""SELECT page_id, array_to_string(list_transform(string_split(c, '-'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '-') AS company
FROM (SELECT page_id, split_part(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HOST}, '^www[.]', ''), '^jobs[.]', ''), '^careers[.]', ''), '^boards[.]', ''), '.', 1) AS c FROM pages)""")
def company_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", url.company_from(F.col("url")).alias("company"))


PORTAL_URLS = [("https://jobs.lever.co/acme-labs/1",), ("https://apply.workable.com/acme/j/1",), ("https://apply.workable.com/j/ACME",), ("https://boards.greenhouse.io/acme-co/jobs/12",), ("https://www.acme.io/jobs/1",), ("https://careers.acme.com/x",), ("https://acme.com/team/x",)]
PORTAL_WANT = [("https://jobs.lever.co/acme-labs/1", "Acme Labs", True), ("https://apply.workable.com/acme/j/1", "Apply", True), ("https://apply.workable.com/j/ACME", "Acme", True), ("https://boards.greenhouse.io/acme-co/jobs/12", "Acme Co", True), ("https://www.acme.io/jobs/1", "Jobs", False), ("https://careers.acme.com/x", "X", False), ("https://acme.com/team/x", "Team", False)]


@query(f"SELECT apply_url, company, is_portal FROM {values('apply_url, company, is_portal', PORTAL_WANT)}")
def portal_company(spark, d):
    return literal(spark, "u", PORTAL_URLS).select(url.company_and_portal(F.col("u")).alias("x")).select("x.apply_url", "x.company", "x.is_portal")


ROUTE_WANT = [("https://www.40seas.com/careers", "site_positions"), ("https://x.example/audiocodes.com", "site_sections"), ("https://acme.example", "generic")]


@query(f"SELECT u, extractor FROM {values('u, extractor', ROUTE_WANT)}")
def source_route(spark, d):
    return literal(spark, "u, e", ROUTE_WANT).select("u", url.route(F.col("u")).alias("extractor"))


BAD = r"(?i)\.(pdf|docx?|xlsx?|csv|zip|rar|7z|png|jpe?g|gif|svg|webp|mp4|mp3|avi|mov|wmv)([?#].*)?$"


COMEET = [("https://www.comeet.com/jobs/acme/A1.23B", True), ("https://eu.comeet.com/jobs/acme/dev/a1.23b", True), ("https://www.comeet.co/jobs/acme/dev/A1.23B", False), ("https://www.comeet.com/jobs/acme", False), ("https://x.example/jobs/acme/A1.23B", False)]


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enrich_overlay(spark, d):
    details = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("lang"))
    return R.overlay(table(spark, d, "documents").select("doc_id", "lang"), details, "doc_id", ["lang"])


@query("SELECT e.event_id AS job_id, CASE WHEN o.o_orderkey IS NULL THEN 'dequeue_missing' WHEN o.o_orderstatus = 'F' THEN 'dequeue_applied' ELSE 'reapply' END AS action FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id WHERE e.ts <= TIMESTAMP '2024-01-20'")
def retry_actions(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("retry_after"))
    return R.retry_actions(q, jobs(spark, d), F.lit("2024-01-20").cast("timestamp")).select("job_id", "action")
