"""The scan as one set-oriented plan: pages, anchors, decision, anti-join, first of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url
from ..operators import relational as R
from ..sources import links
from .common import table
from .store import _HOST, ANCHORS, CHECKED
from .whole import _HREF_OK, _TARGET, _TEXT, _WORDS, RULES, _scored

Q: dict = {}
O: dict[str, str] = {}


def found(pages: DataFrame, rules: links.LinkRules) -> DataFrame:
    """(page_id, pos, title, target, company) of all links of pages that lead to postings; for streams too."""
    a = links.anchors(pages.select("page_id", "url", "html"))
    return a.select("page_id", "pos", F.col("text").alias("title"), rules.decide(F.col("text"), F.col("href"), F.col("url")).alias("target"), url.host(F.col("url")).alias("company")).where("target is not null")


def scan(pages: DataFrame, stored: DataFrame, rules: links.LinkRules) -> DataFrame:
    """New postings (target, title, company): what the store has goes before anything costly; the first of a target wins."""
    return R.first_by(R.having(found(pages, rules), stored.select("target").distinct(), "target", there=False), ["target"], ["page_id", "pos"]).select("target", "title", "company")


def scan_pipeline(spark, d):
    pages = table(spark, d, "pages")
    return scan(pages, pages.select(url.canonical_checked(F.col("url")).alias("target")), RULES)


Q["scan_pipeline"] = scan_pipeline
O["scan_pipeline"] = f"""
WITH found AS (SELECT *, {_WORDS} AS w, text AS title FROM (SELECT page_id, pos, href, {_TEXT} AS text, {_TARGET} AS target, {_HOST} AS company FROM {ANCHORS}))
SELECT target, title, company FROM found WHERE {_HREF_OK} AND href LIKE '/%' AND {_scored(0.1, 'und')} AND target NOT IN (SELECT {CHECKED} FROM pages)
QUALIFY row_number() OVER (PARTITION BY target ORDER BY page_id, pos) = 1
"""
