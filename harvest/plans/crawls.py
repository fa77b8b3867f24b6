"""Queries of crawls over many links and nested frames: the pages, their anchors written anew so that they lead from page to page."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import url
from ..sources import crawl, datasource, links
from .common import table
from .derived import say
from .store import _HOST, ANCHORS
from .whole import _TEXT

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


DEPTH = 4
#: An anchor leads to page 0, which all lead to, or forward or back by the length of its text.
_LINKS = f"(SELECT page_id, CASE pos % 3 WHEN 0 THEN 0 WHEN 1 THEN page_id + length(text) ELSE abs(page_id - length(text)) END AS target FROM (SELECT page_id, pos, {_TEXT} AS text FROM {ANCHORS}))"
_PAGE = "'https://p.example/p/' || "


def site(spark, d):
    """(page_id, host, url, html): the pages as one site whose anchors go where _LINKS says, in markup of several kinds, with two frames
    and one that is gone: the page of twice the number and the one of half of it."""
    own, k = F.col("page_id"), lambda x: F.length(x["text"])
    to = lambda x, i: F.when(i % 3 == 0, F.lit(0)).when(i % 3 == 1, own + k(x)).otherwise(F.abs(own - k(x))).cast("string")
    escaped = lambda x: F.replace(x["text"], F.lit("&"), F.lit("&amp;"))
    item = lambda x, i: F.concat(F.lit("<!-- <a href='/no'>no</a> --><A class='a>b'\n data-href=/no href='/p/"), to(x, i), F.lit("?utm_source=s#t'><b>"), escaped(x), F.lit("</b></A>"))
    anchors = F.array_join(F.transform(links.hrefs(F.col("html")), item), "\n")
    frames = say("<iframe title='a>b' src=\"/p/{twice}\"></iframe><iframe src='/gone'></iframe><IFRAME SRC=/p/{half}></IFRAME>", twice=own * 2 + 1, half=F.floor(own / 2))
    return table(spark, d, "pages").select("page_id", url.host(F.col("url")).alias("host"), say("https://p.example/p/{page_id}").alias("url"), F.concat(anchors, frames).alias("html"))


@query(f"""WITH RECURSIVE a AS {_LINKS},
r AS (SELECT min(page_id) AS page, 0 AS depth FROM pages GROUP BY {_HOST} UNION SELECT a.target, r.depth + 1 FROM r JOIN a ON a.page_id = r.page WHERE r.depth < {DEPTH}),
f AS (SELECT page, min(depth) AS depth FROM r GROUP BY page)
SELECT {_PAGE} f.page AS url, f.depth, (SELECT min({_PAGE} g.page) FROM f g JOIN a ON a.page_id = g.page WHERE g.depth = f.depth - 1 AND a.target = f.page) AS via FROM f""")
def crawl_spread(spark, d):
    """From each host's first page up to DEPTH links away."""
    pages = site(spark, d)
    seeds = pages.groupBy("host").agg(F.min("page_id").alias("page_id")).select(say("https://p.example/p/{page_id}").alias("url"))
    return crawl.spread(seeds, crawl.follow(pages), DEPTH)


@query(f"""WITH RECURSIVE f AS (SELECT page_id AS page, 1 AS frame, page_id * 2 + 1 AS target FROM pages UNION ALL SELECT page_id, 3, page_id // 2 FROM pages),
r AS (SELECT page_id AS root, CAST([] AS INTEGER[]) AS path, page_id AS page, [page_id] AS chain FROM pages
UNION ALL SELECT r.root, list_append(r.path, f.frame), f.target, list_append(r.chain, f.target) FROM r JOIN f ON f.page = r.page
WHERE len(r.path) < 3 AND NOT list_contains(r.chain, f.target) AND f.target IN (SELECT page_id FROM pages))
SELECT {_PAGE} r.root AS url, array_to_string(r.path, '.') AS path, r.page, a.pos, a.text FROM r JOIN (SELECT page_id, pos, {_TEXT} AS text FROM {ANCHORS}) a ON a.page_id = r.page""")
def frame_tree(spark, d):
    """Anchors of every page, of its frames and of theirs, three levels down."""
    got = crawl.nested_anchors(site(spark, d).select("url", "html"), 3)
    return got.select("url", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), F.regexp_extract("page", "[0-9]+$", 0).cast("long").alias("page"), "pos", "text")


_AT = "CASE WHEN url LIKE '%#%' THEN 404 WHEN url LIKE '%//blog.%' THEN NULL WHEN url LIKE '%.net/%' THEN 503 ELSE 200 END"


@query(f"""SELECT page_id, {_AT} AS status, CASE WHEN url LIKE '%#%' THEN 'http 404' WHEN url LIKE '%//blog.%' THEN 'no route' WHEN url LIKE '%.net/%' THEN 'http 503' END AS error,
CASE WHEN url NOT LIKE '%#%' AND (url LIKE '%//blog.%' OR url LIKE '%.net/%') THEN 3 WHEN url NOT LIKE '%#%' AND url LIKE '%/fr/%' THEN 2 ELSE 1 END AS attempts,
CASE WHEN NOT (url LIKE '%#%' OR url LIKE '%//blog.%' OR url LIKE '%.net/%') THEN strlen('page of ' || url) END AS bytes FROM pages""")
def pages_source(spark, d):
    """The pages' addresses through the data source, each once; its getter answers by the address, without a network."""
    p, folder = table(spark, d, "pages").select("page_id", "url"), f"{crawl.scratch(spark)}/{uuid.uuid4().hex}"
    datasource.plan(p.select("url").distinct(), folder, 8)
    got = datasource.read(spark, folder, "harvest.plans.crawls:Answers", rate=1e6, attempts=3, least_ms=0)
    return p.join(got, "url").select("page_id", "status", "error", "attempts", F.octet_length("html").cast("long").alias("bytes"))


class _Answers:
    """A getter without a network: pages of marks are gone, blogs have no route, .net is always busy, French pages are busy at first."""

    def __init__(self):
        self.busy: set[str] = set()  # answered so once; what was served is forgotten, so that a worker's next run finds it busy again

    def __call__(self, address: str) -> tuple[int, dict[str, str], str]:
        if "#" in address:
            return 404, {}, "gone"
        if "//blog." in address:
            raise OSError("no route")
        if ".net/" in address:
            return 503, {"Retry-After": "0"}, "busy"
        if "/fr/" in address and address not in self.busy:
            self.busy.add(address)
            return 503, {"Retry-After": "0"}, "busy"
        self.busy.discard(address)
        return 200, {"Server": "x"}, f"page of {address}"


#: What the source's tasks import by name.
Answers = _Answers()
