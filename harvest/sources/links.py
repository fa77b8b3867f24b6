"""Links of fetched pages: anchors in any markup, the decision about each, the generic crawl, links to an applicant system."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score, text, url
from ..operators import relational as R

# Each of these takes what it begins or fails at its first characters: what is left open runs to the end of the page, as in
# a browser, so a page of any markup is read in time linear in its length. Loops are possessive: Java runs them without recursion.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*+>|\z)|<style\b.*?(?:</style\s*+>|\z)"
_VALUE = r"""(?>"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"']*+)"""
_TAG = r"""<%s\s(?>[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""


def visible(html: Column) -> Column:
    """The markup without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "")


def tags(html: Column, name: str) -> Column:
    """array<string> of all start tags of a name that have attributes, in document order."""
    return F.regexp_extract_all(html, F.lit(f"(?is)({_TAG % name})"), 1)


def attribute(tag: Column, name: str) -> Column:
    """The value of a start tag's first attribute of a name, with entities decoded; null where there is none."""
    other = rf"""(?!{name}\s*+=)[^\s"'>/=]++(?:\s*+=\s*+{_VALUE})?+"""
    raw = F.regexp_extract(tag, rf"""(?is)^<[a-z][^\s>]*+(?>[\s/"'=]++|{other})*+({name}\s*+=\s*+{_VALUE})""", 1)
    value = F.regexp_replace(raw, rf"""(?is)^{name}\s*+=\s*+["']?+|["']\z""", "")
    return F.when(raw != "", text.decode_entities(value))


def hrefs(html: Column) -> Column:
    """array<struct(href, text)> of all anchors with an address, in document order; the text has no tags."""
    found = F.regexp_extract_all(visible(html), F.lit(rf"(?is)({_TAG % 'a'}.*?)(?=</a\s*+>|<a\s|\z)"), 1)
    inner = lambda a: F.regexp_replace(a, rf"(?is)^{_TAG % 'a'}|<[^>]*+(?:>|\z)", "")
    both = F.transform(found, lambda a: F.struct(attribute(a, "href").alias("href"), text.compact(text.decode_entities(inner(a))).alias("text")))
    return F.filter(both, lambda x: x["href"].isNotNull())


def anchors(pages: DataFrame) -> DataFrame:
    """(the pages' columns but html, pos, href, text) of all anchors; pages without one aren't parsed."""
    some = pages.where(F.col("html").rlike(r"(?i)<a\s"))
    return some.select("*", F.posexplode(hrefs(F.col("html"))).alias("pos", "_a")).drop("html").select("*", "_a.href", "_a.text").drop("_a")


def by_href(df: DataFrame, page: str = "url") -> DataFrame:
    """The first anchor of each address of a page, as written, before anything is decided about it."""
    return R.first_by(df, [page, "href"], ["pos"])


@dataclass(frozen=True)
class LinkRules:
    good: list[str] = field(default_factory=list)
    bad: list[str] = field(default_factory=list)
    threshold: float = 0.0
    hard_exclude: bool = False

    def decide(self, label: Column, href: Column, base: Column) -> Column:
        """The canonical address of a link that leads to a posting, null for any other.

        In turn: the address is no mark or file, it stays on the base's scheme and host or goes to a known system, no bad
        word is in text or address (if these exclude), and the score of both reaches the threshold.
        """
        full = url.resolve(href, base)
        both = F.concat_ws(" ", label, full)
        sets = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (self.good, self.bad)]
        ok = ~url.bad_href(href) & url.in_scope(full, base)
        if self.hard_exclude:
            ok = ok & ~F.arrays_overlap(text.tokens(both), sets[1])
        ok = ok & (score.keyword_score(both, *sets) >= self.threshold)
        return F.when(ok, F.nullif(url.canonical_checked(full), F.lit("")))


def crawl(pages: DataFrame, rules: LinkRules, rendered: DataFrame | None = None) -> DataFrame:
    """(page, title, url) of the postings that pages (url, html) link to, each address once by page, the first anchor's.

    A title is the anchor's text or the last part of the address. ``rendered`` (url, pos, href, text) holds anchors that a
    browser saw, those of frames too; they count only for pages whose own anchors lead nowhere, and are scored with their title.
    """

    def postings(a: DataFrame, with_title: bool) -> DataFrame:
        full = url.resolve(F.col("href"), F.col("url"))
        title = F.coalesce(F.nullif(text.compact(F.col("text")), F.lit("")), url.title_from(full))
        got = a.select(F.col("url").alias("page"), "pos", title.alias("title"), rules.decide(title if with_title else F.col("text"), F.col("href"), F.col("url")).alias("url"))
        return R.first_by(got.where("url is not null").withColumn("_key", F.lower("url")), ["page", "_key"], ["pos"]).select("page", "title", "url")

    own = postings(by_href(anchors(pages)), False)
    if rendered is None:
        return own
    rest = rendered.join(own.select(F.col("page").alias("url")).distinct(), "url", "left_anti")
    return own.unionByName(postings(rest, True))


def system_links(pages: DataFrame, across: bool = False) -> DataFrame:
    """(url of the page, pos, target) of links to postings of the applicant system, each target once by page, or once in all."""
    full = url.resolve(F.col("href"), F.col("url"))
    found = anchors(pages).where(F.trim("href") != "").withColumn("_full", full).where(F.coalesce(url.comeet_job(F.col("_full")), F.lit(False)))
    found = found.select("url", "pos", url.canonical_listed(F.col("_full")).alias("target")).withColumn("_key", F.lower("target"))
    return R.first_by(found, ["_key"] if across else ["url", "_key"], ["url", "pos"]).drop("_key")


def older_crawl(pages: DataFrame) -> DataFrame:
    """(url of the page, pos, text, target) by the older rules: the short guard, below the page's path, words of postings,
    and one row of each text and address in all."""
    full = url.resolve(F.col("href"), F.col("url"))
    got = anchors(pages).where(~url.skip_href(F.col("href"))).withColumn("target", full)
    got = got.where(url.below(F.col("target"), F.col("url")) & url.looks_like_job(F.col("text"), F.col("target")))
    return R.first_by(got, [F.lower(text.strip(F.col("text"))), F.lower("target")], ["url", "pos"]).select("url", "pos", "text", "target")
