"""Feeds and embedded JSON as sources: XML repaired before parsing, JSON-LD as an object or an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

ITEM = "struct<title: string, link: string, description: string, pubDate: string, guid: string>"
FEED = f"struct<channel: struct<title: string, link: string, description: string, item: array<{ITEM}>>>"


def feed_items(df: DataFrame, xml: str, now: Column | None = None) -> DataFrame:
    """One row per item with a title and a link: title, link, description as text, location, posted."""
    parsed = df.select(F.from_xml(text.repair_xml(F.col(xml)), FEED).alias("f"))
    items = parsed.select(F.explode("f.channel.item").alias("i")).select(text.strip(F.col("i.title")).alias("title"), text.strip(F.col("i.link")).alias("link"), F.coalesce("i.description", F.lit("")).alias("raw"), "i.pubDate")
    items = items.where((F.col("title") != "") & (F.col("link") != ""))
    plain = text.strip_html(F.col("raw"))
    return items.select("title", "link", plain.alias("description"), text.place_label(plain).alias("location"), dates.feed_date(F.col("pubDate"), now).alias("posted"))


_LD = "struct<`@type`: string, description: string>"


def jsonld_description(s: Column) -> Column:
    """The description of a JobPosting, whether the block is an object or an array; '' for none."""
    named = lambda x: (F.lower(x["@type"]) == "jobposting") & (text.strip(x["description"]) != "")
    one, many = F.from_json(s, _LD), F.from_json(s, f"array<{_LD}>")
    hit = F.get(F.filter(many, named), F.lit(0))["description"]
    return text.strip(F.coalesce(F.when(named(one), one["description"]), hit, F.lit("")))


def position_detail(s: Column, name: str) -> Column:
    """The value of the first detail in a position's payload whose name holds a word; '' for none."""
    payload = F.from_json(s, "struct<custom_fields: struct<details: array<struct<name: string, value: string>>>>")
    hit = F.filter(payload["custom_fields"]["details"], lambda x: F.contains(F.lower(x["name"]), F.lit(name.lower())))
    return text.strip(F.coalesce(F.get(hit, F.lit(0))["value"], F.lit("")))
