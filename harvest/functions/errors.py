"""Errors as structs, and what may be tried again; columns. error: struct(type, message, cause, context map, at)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .text import strip

# Types, statuses and words of errors that may pass.
TYPES = ["Unknown", "Network", "Database", "Parsing", "Validation", "Timeout", "Configuration", "Resource"]
#: What an error text says behind a limit.
LIMITED = "429|rate limit|too many requests"
RETRY_STATUS = [408, 429, 500, 502, 503, 504]
RETRY_WORDS = "timeout|connection refused|connection reset|temporary failure"
NO_CONTEXT = "cast(map() as map<string, string>)"


def error(kind: str, message: Column, cause: Column | None = None, at: Column | None = None) -> Column:
    if kind not in TYPES:
        raise ValueError(f"error type {kind!r}")
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), message.alias("message"), (none if cause is None else cause).alias("cause"), F.expr(NO_CONTEXT).alias("context"), F.unix_seconds(F.lit(None).cast("timestamp") if at is None else at).cast("string").alias("at"))


def with_context(e: Column, key: Column, value: Column) -> Column:
    """A key that is there already gets the new value."""
    return e.withField("context", F.map_concat(F.map_filter(e["context"], lambda k, _: k != key), F.create_map(key, value)))


def wrap(e: Column, message: Column) -> Column:
    """A typed error gets the message as context; null stays null."""
    return F.when(e.isNotNull(), with_context(e, F.lit("wrapped_message"), message))


def wrap_text(cause: Column, message: Column, at: Column | None = None) -> Column:
    """A plain error becomes the cause of one of unknown type."""
    return F.when(cause.isNotNull(), error("Unknown", message, cause, at))


def said(e: Column) -> Column:
    return F.when(e["cause"].isNotNull(), F.concat(e["message"], F.lit(": "), e["cause"])).otherwise(e["message"])


def is_type(e: Column, kind: str) -> Column:
    return e["type"] == kind


def retryable(e: Column) -> Column:
    return e["type"].isin("Network", "Timeout")


def retryable_text(s: Column) -> Column:
    return F.lower(s).rlike(RETRY_WORDS)


def rate_limited(s: Column) -> Column:
    return F.lower(s).rlike(LIMITED)


def timed_out(s: Column) -> Column:
    return F.coalesce(s.rlike("deadline exceeded|Client.Timeout exceeded|i/o timeout"), F.lit(False))


def summary(e: Column) -> Column:
    """JSON of the message, type and time, and the context where there is one."""
    return F.to_json(F.struct(said(e).alias("error"), e["type"].alias("type"), e["at"].alias("timestamp"), F.when(F.size(e["context"]) > 0, e["context"]).alias("context")))


def retry_status(code: Column) -> Column:
    return code.isin(*RETRY_STATUS)


def most_backoff(attempt: Column, least_ms: float, most_ms: float) -> Column:
    return F.least(F.lit(float(most_ms)), F.lit(float(least_ms)) * F.pow(F.lit(2.0), attempt - 1))


def backoff(attempt: Column, least_ms: float, most_ms: float, seed: int | None = None) -> Column:
    """A random wait below the bound, which doubles with each attempt."""
    return F.floor(most_backoff(attempt, least_ms, most_ms) * F.rand(seed))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a positive number, or a date within ten minutes; else 0."""
    v = strip(value)
    n = F.when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("long"))
    wait = F.unix_seconds(dates.feed_date(v)) - F.unix_seconds(now)
    return F.coalesce(F.when(n > 0, n), F.when((wait > 0) & (wait < 600), wait), F.lit(0).cast("long"))
