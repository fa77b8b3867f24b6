"""URL filters as a temporal join with dated lists; DataFrame functions only.

A list is a log of dated entries (added, removed, added again). Each becomes an interval of validity,
from its date to the next entry for the same pattern. Each capture offers its keys (URL, host and path
prefixes, host, parent domains) and an as-of join finds the intervals that hold at its fetch time.
The most specific pattern decides: url, then path, host, domain; then the longer pattern; then allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The intervals are broadcast only while both hold, as counted; beyond, the join shuffles and AQE splits hot keys.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8 << 20
#: Keys that a capture offers (by the deepest path and domain of the list) while it meets the list key by key.
BROADCAST_KEYS = 32
SCOPES = ["domain", "host", "path", "url"]


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, scope, pattern, verdict, valid_from, valid_to) from entries (list_name, scope, pattern, verdict, action, at).

    ``valid_to`` is exclusive and null while the entry stands. At equal times a removal comes last. Entries
    with a null scope, pattern, action or date hold nothing; repeated entries hold once.
    """
    log = entries.select("list_name", "scope", "pattern", "verdict", "action", "at").where("scope is not null and pattern is not null and action is not null and at is not null").distinct()
    w = Window.partitionBy("list_name", "scope", "pattern").orderBy("at", "action", "verdict")
    return log.withColumn("valid_to", F.lead("at").over(w)).where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))).select("list_name", "scope", "pattern", "verdict", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """Lower-cased host without user info, port and dots at its end; '' for what has none. An IPv6 address keeps its brackets."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", ""))


def place_of(url: Column) -> Column:
    """Host and path, without query and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def _keys(depth: int, labels: int) -> list[tuple[str, Column]]:
    """(scope, pattern) of what a capture offers: URL, host, its path prefixes and its parent domains."""
    url = F.col("url")
    host, place = host_of(url), place_of(url)
    parts, names = F.size(F.split(place, "/")), F.size(F.split(host, r"\."))
    keys = [("url", F.regexp_replace(url, "#.*$", "")), ("host", host)]
    keys += [("path", F.when(parts > d, F.substring_index(place, "/", d + 1))) for d in range(depth + 1)]
    return keys + [("domain", F.when(names >= n, F.substring_index(host, ".", -n))) for n in range(1, labels + 1)]


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per capture (page_id, url, fetched_at): host, decision and the entry that decides.

    ``decision`` is block, allow or none (no entry holds: null list_name, scope, pattern, valid_from), and
    ``n_active`` counts the entries that hold. A null url or fetch time matches nothing. Repeated captures
    keep their rows. While the list is broadcast a capture meets it key by key and is never shuffled; a larger list is
    joined by shuffle, and each capture's matches meet by row.
    """
    valid = intervals(entries)
    size = valid.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.when(F.col("scope") == "path", F.size(F.split("pattern", "/")) - 1)), F.lit(-1)).alias("depth"),
        F.coalesce(F.max(F.when(F.col("scope") == "domain", F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"),
    ).first()
    own = captures.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    keys = _keys(size["depth"], size["labels"])
    holds = lambda x, at: (at >= x["valid_from"]) & (x["valid_to"].isNull() | (at < x["valid_to"]))
    rank = lambda x: F.struct(F.array_position(F.array(*map(F.lit, SCOPES)), x["scope"]).alias("a"), F.length(x["pattern"]).alias("b"), (x["verdict"] == "allow").cast("int").alias("c"), x["valid_from"].alias("d"), x["list_name"].alias("e"))
    entry = F.struct("verdict", "list_name", "scope", "pattern", "valid_from", "valid_to")
    if size["n"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES and len(keys) <= BROADCAST_KEYS:
        spans = valid.groupBy("scope", F.col("pattern").alias("_h_key")).agg(F.collect_list(entry).alias("_h_spans"))
        empty = F.array().cast("array<struct<verdict: string, list_name: string, scope: string, pattern: string, valid_from: timestamp, valid_to: timestamp>>")
        out, met = own, []
        for k, (scope, key) in enumerate(keys):
            side = spans.where(F.col("scope") == scope).select(F.col("_h_key").alias(f"_h_k{k}"), F.col("_h_spans").alias(f"_h_s{k}"))
            out = out.withColumn(f"_h_k{k}", key).join(F.broadcast(side), f"_h_k{k}", "left")
            met.append(F.coalesce(f"_h_s{k}", empty))
        out = out.withColumn("_h_met", F.coalesce(F.filter(F.concat(*met), lambda x: holds(x, F.col("fetched_at"))), empty))
        best = F.array_max(F.transform("_h_met", lambda x: F.struct(rank(x).alias("rank"), x.alias("entry"))))["entry"]
        out = out.select("page_id", "url", "host", "fetched_at", best.alias("_h_best"), F.size("_h_met").cast("long").alias("n_active"))
    else:
        offered = own.withColumn("_h_row", F.monotonically_increasing_id())
        offered = offered.withColumn("_h_key", F.explode_outer(F.filter(F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("pattern")) for s, k in keys]), lambda x: x["pattern"].isNotNull())))
        held = offered.select("*", "_h_key.*").drop("_h_key").join(valid, ["scope", "pattern"], "left").withColumn("_h_holds", F.coalesce(holds({c: F.col(c) for c in ("valid_from", "valid_to")}, F.col("fetched_at")), F.lit(False)))
        columns = {c: F.col(c) for c in ("verdict", "list_name", "scope", "pattern", "valid_from", "valid_to")}
        best = F.max_by(F.when(F.col("_h_holds"), entry), F.when(F.col("_h_holds"), rank(columns)))
        out = held.groupBy("_h_row").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "host", "fetched_at")), best.alias("_h_best"), F.count_if("_h_holds").alias("n_active"))
    return out.select("page_id", "url", "host", "fetched_at", F.coalesce("_h_best.verdict", F.lit("none")).alias("decision"), "_h_best.list_name", "_h_best.scope", "_h_best.pattern", "_h_best.valid_from", "n_active")
