"""Crawls over a table of fetched pages (url, html): paged boards, sites with detail pages, anchors inside frames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import url
from ..operators import relational as R
from . import links as L


def scratch(spark: SparkSession) -> str:
    """The application's checkpoint folder, in the folder that the session names; one that names none gets a temporary one, on a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="harvest-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession)
    return df.checkpoint()


def frontier(edges: DataFrame) -> DataFrame:
    """Addresses that no other page leads to: where chains begin."""
    led = edges.where("next is not null and next <> url").select(F.col("next").alias("url")).distinct()
    return R.having(edges.select("url"), led, "url", there=False).distinct()


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, url, depth) of all pages that each seed's chain of next pages leads to, itself at depth 0.

    edges: url (unique, of any type), next (null for none). Distances double each round, so a chain of n pages takes log2(n) joins; a page that
    comes again ends its chain.
    """
    jump = _cut(edges.select(F.col("url").alias("a"), F.col("next").alias("b")).where("b is not null and a <> b"))
    found = _cut(seeds.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth")).distinct())
    step, known = 1, found.count()
    while True:
        more = found.join(jump, F.col("url") == F.col("a")).select("seed", F.col("b").alias("url"), (F.col("depth") + step).alias("depth"))
        found = _cut(found.unionByName(more).groupBy("seed", "url").agg(F.min("depth").alias("depth")))
        now = found.count()
        if now == known:
            return found
        other = jump.select(F.col("a").alias("m"), F.col("b").alias("c"))
        jump = _cut(jump.join(other, F.col("b") == F.col("m")).select("a", F.col("c").alias("b")))
        known, step = now, step * 2


def follow(fetched: DataFrame, keep: Callable[[Column, Column], Column] = url.in_scope) -> Callable[[DataFrame], DataFrame]:
    """What ``spread`` asks of fetched pages (url, html; url unique and canonical as stored): the links of the pages reached.

    Only pages of the frontier are joined and parsed, each once. ``keep`` takes a link's canonical address and its page's.
    """

    def expand(frontier: DataFrame) -> DataFrame:
        a = L.anchors(frontier.join(fetched.select("url", "html"), "url"))
        a = a.where(~url.bad_href(F.col("href"))).withColumn("_full", url.resolve(F.col("href"), F.col("url")))
        # a generator keeps the optimizer from writing the address out again wherever the condition names it
        a = a.select("url", "pos", F.explode(F.array(url.canonical_stored(F.col("_full")))).alias("target"))
        return a.where(keep(F.col("target"), F.col("url")))

    return expand


def spread(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """(url, depth, via) of every address that at most ``depth`` links lead to from the seeds (url), each once.

    Level by level: ``expand`` gets the addresses new at a level (url) and gives their links (url, pos, target), many for each;
    targets that no level had before are the next one. ``depth`` is the smallest, ``via`` the page of that level that leads there (the
    smallest url). Cycles end by the visited set, which is the levels' own checkpoints. Links to one target combine
    before they move and a page is expanded once, so neither a target nor a page that all link to is a hot key. Null
    addresses lead nowhere; an address that was not fetched is reached, but has no links.
    """
    new = _cut(seeds.select(F.col("url")).where("url is not null").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["url"].dataType).alias("via")))
    levels = [new]
    for level in range(1, depth + 1):
        found = expand(new.select("url")).where("target is not null").groupBy("target").agg(F.min("url").alias("via"))
        before = reduce(DataFrame.unionByName, levels).select(F.col("url").alias("target"))
        new = _cut(found.join(before, "target", "left_anti").select(F.col("target").alias("url"), F.lit(level).alias("depth"), "via"))
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels)


def crawl_boards(fetched: DataFrame, seeds: DataFrame, parser=P.board_page) -> DataFrame:
    """(seed, title, url) of the postings on all pages of each board, a title and address once by page and place.

    fetched: url (unique), html; seeds: url of each board's first page, also the base of its links. A page that was
    not fetched ends its chain.
    """
    udf = P.links_udf(parser)
    edges = fetched.select("url", F.nullif(udf("html", "url", "url").getField("next"), F.lit("")).alias("next"))
    at = reach(edges, seeds).join(fetched, "url").select("seed", "depth", udf("html", "url", "seed").getField("links").alias("links"))
    links = at.select("seed", "depth", F.posexplode("links").alias("pos", "x")).select("seed", "depth", "pos", "x.title", "x.url")
    return R.first_by(links, ["seed", F.lower(F.trim("title")), F.lower(F.trim("url"))], ["depth", "pos"]).select("seed", "title", "url")


def crawl_site(links: DataFrame, fetched: DataFrame, site: str) -> DataFrame:
    """(url, title, description) of a site's postings: its links by path, each once, with what its detail page holds."""
    kept = R.first_by(links.where(url.site_path(F.col("url"), site)).select("url", "title", "pos"), [F.lower(url.canonical_stored(F.col("url")))], ["pos"])
    body = fetched.select(F.col("url").alias("_u"), P.sections(site)("html").alias("description"))
    return kept.join(body, F.col("url") == F.col("_u")).select("url", "title", "description")


def crawl_blocks(fetched: DataFrame) -> DataFrame:
    """(url, title, description) of postings that share a page; each gets an address of its own."""
    from ..functions import text

    x = fetched.select("url", F.explode(P.blocks("html")).alias("x"))
    return x.select(url.with_item(F.col("url"), text.slug(F.col("x.title"))).alias("url"), "x.title", "x.description")


def anchors_with_frames(fetched: DataFrame, anchors: Column) -> DataFrame:
    """(url, level, pos, x) of a page's anchors and then those of the pages in its frames; frames not fetched are left out.

    anchors: array of a page's anchors made from ``html``.
    """
    own = fetched.select("url", F.lit(0).alias("level"), F.posexplode(anchors).alias("pos", "x"))
    src = fetched.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<iframe[^>]*\ssrc="([^"]*)"'), 1)).alias("level", "src"))
    src = src.select(F.col("url").alias("page"), (F.col("level") + 1).alias("level"), url.resolve(F.col("src"), F.col("url")).alias("url"))
    inner = src.join(fetched, "url").select(F.col("page").alias("url"), "level", F.posexplode(anchors).alias("pos", "x"))
    return own.unionByName(inner)


def frames(fetched: DataFrame) -> DataFrame:
    """(url, frame, target) of the frames with an address that pages (url, html) show, in document order from 1."""
    some = fetched.where(F.col("html").rlike(r"(?i)<iframe\s"))
    found = F.filter(F.transform(L.tags(L.visible(F.col("html")), "iframe"), lambda t: L.attribute(t, "src")), lambda x: F.trim(x) != "")
    found = some.select("url", F.posexplode(found).alias("k", "src"))
    return found.select("url", (F.col("k") + 1).alias("frame"), url.resolve(F.col("src"), F.col("url")).alias("target"))


def nested_anchors(fetched: DataFrame, depth: int, pages: DataFrame | None = None) -> DataFrame:
    """(url, path, page, pos, href, text): a page's anchors and those of its frames and theirs, ``depth`` levels down.

    ``path`` has the places of the frames that lead from ``url`` to ``page`` (empty for its own anchors); with ``pos`` it orders the anchors. A frame
    that was not fetched is left out, and so is one that already holds itself. ``pages`` (url) says whose anchors are
    wanted, by default all. Each level joins pages with their frames, each page of which is parsed once.
    """
    inside = _cut(frames(fetched))
    at = (fetched if pages is None else pages).select("url", F.array().cast("array<int>").alias("path"), F.col("url").alias("page"), F.array("url").alias("chain"))
    levels = [_cut(at)]
    there = fetched.select(F.col("url").alias("target"))
    step = R.having(inside, there, "target").select(F.col("url").alias("page"), "frame", "target")
    for _ in range(depth):
        down = levels[-1].join(step, "page").where(~F.array_contains("chain", F.col("target")))
        down = _cut(down.select("url", F.concat("path", F.array("frame")).alias("path"), F.col("target").alias("page"), F.concat("chain", F.array("target")).alias("chain")))
        if down.isEmpty():
            break
        levels.append(down)
    shown = L.anchors(fetched.select(F.col("url").alias("page"), "html"))
    return reduce(DataFrame.unionByName, levels).join(shown, "page").select("url", "path", "page", "pos", "href", "text")
