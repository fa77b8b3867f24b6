"""Enrichment of listings from boards, feeds and companies into one form; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, url

COLUMNS = ["title", "url", "source", "company", "apply_url", "via_portal", "location", "description", "email", "phone", "posted"]


def _or(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def from_feed(df: DataFrame) -> DataFrame:
    """Rows (title, url, description as HTML, pub_date, source): company and portal by the address, place by its label."""
    x, plain = url.company_and_portal(F.col("url")), text.strip_html(F.coalesce("description", F.lit("")))
    portal = x["is_portal"] & (x["company"] != "")
    return df.select(
        _or(F.col("title"), url.title_from(F.col("url"))).alias("title"), "url", "source", _or(x["company"], F.col("source")).alias("company"),
        F.when(portal, x["apply_url"]).otherwise("").alias("apply_url"), portal.alias("via_portal"), text.place_label(plain).alias("location"),
        plain.alias("description"), F.lit("").alias("email"), F.lit("").alias("phone"), dates.feed_date(F.col("pub_date")).alias("posted"),
    )


def from_board(df: DataFrame, today: Column) -> DataFrame:
    """Rows (title, url, company, location, description, email, phone, date_posted, source, board_url).

    A link away from the board gives the company by its address and where to apply; the board's own postings keep the
    company they name. The board's name stands in for a missing company and the title for a missing description.
    """
    x = url.company_and_portal(F.col("url"))
    away = url.host(F.col("url")) != url.host(F.col("board_url"))
    posted = F.coalesce(dates.relative_date(F.col("date_posted"), today).cast("timestamp"), dates.posted_date(F.col("date_posted")))
    return df.select(
        "title", "url", "source", F.when(away, _or(x["company"], F.col("source"))).otherwise(_or(F.col("company"), F.col("source"))).alias("company"),
        F.when(away, _or(x["apply_url"], F.col("url"))).otherwise("").alias("apply_url"), (away & x["is_portal"]).alias("via_portal"),
        _or(F.col("location")).alias("location"), _or(F.col("description"), F.col("title")).alias("description"), _or(F.col("email")).alias("email"), _or(F.col("phone")).alias("phone"), posted.alias("posted"),
    )


def from_company(df: DataFrame, details: DataFrame) -> DataFrame:
    """Rows (title, url, company) with what ``page_details`` found at their address where it isn't empty.

    details: url (unique), title, description, location, email, phone, date.
    """
    d = details.select(F.col("url").alias("_u"), *(F.col(c).alias(f"_{c}") for c in ("title", "description", "location", "email", "phone", "date")))
    got = df.join(d, F.col("url") == F.col("_u"), "left")
    title = _or(F.col("_title"), F.col("title"))
    return got.select(
        title.alias("title"), "url", F.col("company").alias("source"), "company", F.lit("").alias("apply_url"), F.lit(False).alias("via_portal"),
        _or(F.col("_location")).alias("location"), _or(F.col("_description"), title).alias("description"), _or(F.col("_email")).alias("email"), _or(F.col("_phone")).alias("phone"), dates.stamp(F.col("_date")).alias("posted"),
    )
