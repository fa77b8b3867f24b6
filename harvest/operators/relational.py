"""Ordered deduplication, merges and the search page; DataFrame compositions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.errors import rate_limited
from ..functions.text import key_id, like_ascii, normalize, phrase, sha16, strip, tokens
from ..functions.url import board_host

DEFAULT_LIMIT, MOST_LIMIT = 25, 200


def first_by(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order.

    A min over (order, row) aggregates before it shuffles, so a key that holds many rows is no hot task.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    held = df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])).alias("_row"))
    return held.select("_row.*")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], order: str | None = None) -> DataFrame:
    """Rows of the target with ``update`` columns from the source's row of the key, and the source's new rows.

    Of source rows with one key the last in ``order`` gives the updates and the first all else of a new row.
    """
    if order:
        rest = [c for c in source.columns if c not in keys and c not in update]
        last, first = (f(F.struct(*cols), order).alias(n) if cols else F.lit(None).alias(n) for f, cols, n in ((F.max_by, update, "_l"), (F.min_by, rest, "_f")))
        merged = source.groupBy(*keys).agg(last, first)
        source = merged.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in update), *(F.col(f"_f.{c}").alias(c) for c in rest))
    t = target.select(F.lit(True).alias("_t"), *(F.col(c).alias(f"t_{c}") for c in target.columns))
    s = source.select(F.lit(True).alias("_s"), *(F.col(c).alias(f"s_{c}") for c in source.columns))
    on = [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = t.join(s, cond, "full_outer")
    out = []
    for c in target.columns:
        if c not in source.columns:
            out.append(F.col(f"t_{c}").alias(c))
        elif c in update:
            out.append(F.when(F.col("_s"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_t"), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}")).alias(c))
    return joined.select(*out)


def delete_by(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def update_by(df: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Rows whose key is among the ids get new values."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def rejects(df: DataFrame, dimension: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose foreign key finds nothing."""
    return df.join(dimension.select(F.col(other).alias(key)).distinct(), key, "left_anti")


@dataclass
class JobQuery:
    q: str = ""
    company_id: int | str | None = None
    hide_applied: bool = False
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def bounded(self) -> tuple[int, int]:
        """A limit out of range is reset to the default, not cut; a negative offset is 0."""
        return (self.limit if 0 < self.limit <= MOST_LIMIT else DEFAULT_LIMIT), max(0, self.offset)


def search(jobs: DataFrame, companies: DataFrame, query: JobQuery) -> DataFrame:
    """The filtered join that both the page and its total use; only clauses whose parameter is set take part.

    jobs: id, company_id, title, description, location, applied, banned, discovered_at; companies: id, name.
    """
    df = jobs.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
    df = df.where(~F.coalesce(F.col("banned"), F.lit(False)))
    if query.company_id is not None:
        df = df.where(F.col("company_id") == query.company_id)
    if query.q:
        df = df.where(like_ascii(F.col("title"), query.q) | like_ascii(F.col("description"), query.q) | like_ascii(F.col("location"), query.q) | like_ascii(F.col("company_name"), query.q))
    if query.hide_applied:
        df = df.where(~F.col("applied"))
    return df


def page(jobs: DataFrame, companies: DataFrame, queue: DataFrame, query: JobQuery) -> DataFrame:
    """One page, newest first, ties by id, with the queue's due time; the queue is joined to the page alone."""
    limit, offset = query.bounded()
    rows = search(jobs, companies, query).orderBy(F.desc("discovered_at"), "id").offset(offset).limit(limit)
    return rows.join(queue.select(F.col("job_id").alias("id"), "retry_after"), "id", "left")


def overlay(df: DataFrame, details: DataFrame, key: str, columns: list[str], need: str | None = None) -> DataFrame:
    """Fetched values take the place of a row's own where they aren't empty; a row that has none of ``need`` then goes."""
    d = details.select(key, *(F.col(c).alias(f"_d_{c}") for c in columns))
    if need is not None:
        laid = overlay(df, details, key, columns)
        return laid.where(F.trim(F.col(need).cast("string")) != "")
    return df.join(d, key, "left").select(*(F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def due(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where(F.col("retry_after") <= now).orderBy("retry_after", "job_id")


def retry_actions(queue: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """What to do with each due entry: dequeue a missing or applied job, else try again."""
    j = jobs.select(F.col("id").alias("job_id"), F.col("applied").alias("_applied"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "dequeue_missing").when(F.col("_applied"), "dequeue_applied").otherwise("reapply")
    return queue.where(F.col("retry_after") <= now).join(j, "job_id", "left").select(*queue.columns, action.alias("action"))


def recent(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, newest first; all of them where n isn't positive."""
    rows = df.orderBy(F.desc(order))
    return rows.limit(n) if n > 0 else rows


def bounded_updates(n: int, default: int = 20, most: int = 100) -> int:
    """How many updates a request gets: a number out of range is the default."""
    return n if 0 < n <= most else default


def active_sorted(df: DataFrame, active: Column, name: str) -> DataFrame:
    return df.where(active).orderBy(name)


def multi_get(df: DataFrame, ids: list, key: str, columns: list[str]) -> DataFrame:
    """Some columns of the rows with these ids; no ids, no rows and no scan."""
    return df.where(F.col(key).isin(ids)).select(*columns) if ids else df.select(*columns).limit(0)


def having(df: DataFrame, other: DataFrame, on: Column | str | list[str], there: bool = True) -> DataFrame:
    """Rows that have a match, or that have none."""
    return df.join(other, on, "left_semi" if there else "left_anti")


def affected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: how many rows a change of these ids touches."""
    return having(df, ids.select(key).distinct(), key).agg(F.count("*").alias("affected"))


def postpone(queue: DataFrame, ids: DataFrame, until: Column) -> DataFrame:
    return update_by(queue, ids, "job_id", {"retry_after": until})


def percent(done: Column, total: Column) -> Column:
    """Whole percents; 0 of nothing."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0).cast("long"))


def page_info(total: Column, limit: Column, offset: Column) -> Column:
    """struct(page, pages, has_next)."""
    return F.struct((F.floor(offset / limit) + 1).alias("page"), F.greatest(F.lit(1), F.ceil(total / limit)).alias("pages"), (offset + limit < total).alias("has_next"))


def envelope(rows: DataFrame, total: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row with the JSON {items, total, limit, offset} of a page, whose order stays, and of its total (one row, one column)."""
    items = rows.select(F.monotonically_increasing_id().alias("_n"), F.struct(*rows.columns).alias("_i")).agg(F.sort_array(F.collect_list(F.struct("_n", "_i"))).alias("_l"))
    joined = items.join(F.broadcast(total.toDF("total")))  # one row each
    return joined.select(F.to_json(F.struct(F.transform("_l", lambda x: x["_i"]).alias("items"), "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))).alias("json"))


def decode(df: DataFrame, body: str, schema: str) -> DataFrame:
    """Fields of JSON requests; ``bad`` marks a body that is none, whose fields are null."""
    parsed = F.from_json(body, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("_p", parsed).select(*df.columns, "_p.*").withColumn("bad", F.col("_bad").isNotNull() | F.col(body).isNull()).drop("_bad")


def frame(event: Column, data: Column) -> Column:
    """A server-sent event: its name and its data as JSON (a struct), closed by an empty line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def by_title_and_url(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first row of each title and address, in any case and without blanks around them."""
    return first_by(df, [F.lower(strip(F.col("title"))), F.lower(strip(F.col("url")))], order)


def by_normal_text(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first row of each normalised title and address; rows without either meet by a hash of both as they are."""
    title, address = (normalize(F.coalesce(c, F.lit(""))) for c in ("title", "url"))
    bare = (title == "") & (address == "")
    other = F.when(bare, sha16(F.concat_ws(" | ", strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("url", F.lit(""))))))
    return first_by(df, [title, address, F.coalesce(other, F.lit(""))], order)


def named(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, name) of several sources, one after the other."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(column).alias("name")) for kind, (df, column) in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def first_key(df: DataFrame, candidates: list[tuple[str, DataFrame, str, str]], out: str) -> DataFrame:
    """Rows with the first key that one of the candidates (own column, dimension, its column, its key) leads to; others go."""
    found = []
    for n, (own, dimension, column, key) in enumerate(candidates):
        side = dimension.groupBy(F.col(column).alias(f"_m{n}")).agg(F.min(key).alias(f"_k{n}"))
        df = df.join(side, F.col(own) == F.col(f"_m{n}"), "left")
        found.append(F.col(f"_k{n}"))
    columns = [c for c in df.columns if not c.startswith(("_m", "_k"))]
    return df.select(*columns, F.coalesce(*found).alias(out)).where(F.col(out).isNotNull())


def lookup_or_create(df: DataFrame, dimension: DataFrame, name: str, fallback: Column, make: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``id`` of the dimension, the dimension with what it lacked). A row without a name takes the fallback.

    dimension: id, name, and the columns of ``make``, which are expressions over (name, and the row that is first by
    address). A new id comes from the name, so that a second run makes the same.
    """
    rows = df.withColumn("_name", F.coalesce(F.nullif(F.col(name), F.lit("")), fallback))
    asked = rows.groupBy(F.col("_name").alias("name")).agg(*(F.min(v).alias(c) for c, v in make.items()))
    new = having(asked, dimension.select("name"), "name", there=False).withColumn("id", key_id(F.lit("company"), F.col("name")))
    whole = dimension.unionByName(new.select(*dimension.columns))
    return rows.join(whole.select(F.col("name").alias("_name"), "id"), "_name").drop("_name"), whole


def poll_counts(found: DataFrame, before: DataFrame, feed: str, keys: list[str]) -> DataFrame:
    """(feed, found, new, updated) of a poll: what the feed gave, and of its distinct keys what the store lacked or had."""
    known = found.join(before.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    per_key = known.groupBy(feed, *keys).agg(F.count("*").alias("n"), F.max("_there").alias("there"))
    return per_key.groupBy(feed).agg(F.sum("n").alias("found"), F.count_if(F.col("there").isNull()).alias("new"), F.count_if("there").alias("updated"))


def feed_status(registry: DataFrame) -> DataFrame:
    """One row: enabled, total_feeds, enabled_feeds of the registry's feeds."""
    feeds = registry.where(F.lower(strip(F.col("type"))) == "rss_feed")
    return feeds.agg((F.count_if("active") > 0).alias("enabled"), F.count("*").alias("total_feeds"), F.count_if("active").alias("enabled_feeds"))


def cache_sizes(df: DataFrame, cache: str, key: str) -> DataFrame:
    return df.select(F.col(cache).alias("cache"), key).distinct().groupBy("cache").agg(F.count("*").alias("keys"))


def intern_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: hits and misses of a pool of strings; the empty string is never pooled."""
    return df.where(F.col(text) != "").groupBy(text).count().agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("hits"), F.count("*").alias("misses"))


def pool_stats(df: DataFrame, pool: str, done: Column) -> DataFrame:
    """(pool, submitted, completed, rejected): what isn't done, or unknown, was rejected."""
    return df.groupBy(pool).agg(F.count("*").alias("submitted"), F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("rejected"))


def message(parts: list[Column]) -> Column:
    """Lines of a message, those that are null left out."""
    return F.concat_ws("\n", *parts)


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def rate(df: DataFrame, key: list[str], ts: str, seconds: int = 300) -> DataFrame:
    """Events per second over the time up to each event, ends included, by key.

    Rows are dealt by key and by stretch of time: each also goes to the next stretch, where it only counts, so that no task
    holds a key's whole log.
    """
    at, span = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    own = F.floor(at / span).cast("long")
    dealt = df.withColumn("_at", at).withColumn("_to", F.explode(F.array(own, own + 1))).withColumn("_own", F.col("_to") == own)
    w = Window.partitionBy(*key, "_to").orderBy("_at").rangeBetween(-span, 0)
    return dealt.withColumn("rate", F.count("*").over(w) / F.lit(float(seconds))).where("_own").drop("_at", "_to", "_own")


def retry_run(queue: DataFrame, jobs: DataFrame, outcomes: DataFrame, now: Column, hours: int) -> tuple[DataFrame, DataFrame]:
    """(actions, the queue after them) of one run of the retry worker.

    Of due entries those of missing or applied jobs leave the queue; of the others ``outcomes`` (job_id, error) tells
    how the new attempt ended: without an error the entry goes, behind a limit it waits again, with any other error it stays.
    An entry without an outcome stays too.
    """
    due_ones = retry_actions(queue, jobs, now).select("job_id", "action")
    tried = due_ones.join(outcomes.select("job_id", "error", F.lit(True).alias("_tried")), "job_id", "left")
    limited = rate_limited(F.col("error"))
    done = F.when(F.col("action") != "reapply", F.col("action")).when(F.col("_tried").isNull(), "keep").when(F.coalesce("error", F.lit("")) == "", "applied").when(limited, "requeue").otherwise("keep")
    actions = tried.select("job_id", done.alias("action"))
    after = queue.join(actions, "job_id", "left").where(F.coalesce("action", F.lit("keep")).isin("keep", "requeue"))
    return actions, after.withColumn("retry_after", F.when(F.col("action") == "requeue", now + F.make_interval(hours=F.lit(hours))).otherwise(F.col("retry_after"))).drop("action")


def board_by_host(df: DataFrame, registry: DataFrame, u: str = "url") -> DataFrame:
    """Rows with the name of the first board (by ``pos``) whose host is that of their address; rows without one go.

    registry: pos, name, source_url; a handful of rows, reduced to one a host before the join.
    """
    boards = registry.select(board_host(F.col("source_url")).alias("_host"), "name", "pos").where("_host <> ''")
    boards = boards.groupBy("_host").agg(F.min_by("name", "pos").alias("board"))
    return df.withColumn("_host", board_host(F.col(u))).join(boards, "_host").drop("_host")


def choose_profile(title: Column, profiles: list[tuple[str, list[str], str]], default: str) -> Column:
    """struct(name, path, score) of the profile (name, patterns, path) with the most points, the first of equals.

    A phrase that occurs gives 3 points and a single word 1; without a path the default takes its place.
    """
    low, words = F.lower(strip(title)), tokens(title)
    scored = []
    for n, (name, patterns, path) in enumerate(profiles):
        points = F.lit(0)
        for p in (x.strip().lower() for x in patterns):
            points = points + (F.when(phrase(low, p), 3).otherwise(0) if " " in p else F.array_contains(words, p).cast("int"))
        scored.append(F.struct(points.alias("score"), F.lit(-n).alias("n"), F.lit(name).alias("name"), F.lit(path).alias("path")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    blank = F.trim(best["path"]) == ""
    return F.struct(F.when(blank, "default").otherwise(best["name"]).alias("name"), F.when(blank, default).otherwise(best["path"]).alias("path"), best["score"].alias("score"))


def outbox(jobs: DataFrame, body: Column, applicant: str, profiles: list[tuple[str, list[str], str]], default: str, files: DataFrame) -> DataFrame:
    """(job_id, recipient, subject, body, resume, profile, attachment, preview, error) of the mail that applies for each job; nothing is sent.

    jobs: job_id, title, recipient. The résumé is that of the profile chosen by title; it is attached when it is a PDF among ``files`` (path), the
    folder's listing. A job whose company has no address is an error and has no mail; ``preview`` are the body's first 400 characters.
    """
    own = jobs.select("job_id", F.trim("recipient").alias("recipient"), "title", choose_profile(F.col("title"), profiles, default).alias("_c"), body.alias("body"))
    there = files.select(F.col("path").alias("_path")).where(F.lower("_path").endswith(".pdf")).distinct()
    own = own.join(there, F.col("_c.path") == F.col("_path"), "left")
    ok = F.coalesce(F.col("recipient") != "", F.lit(False))
    mail = lambda c: F.when(ok, c)
    subject = F.concat(F.lit("Application: "), F.coalesce("title", F.lit("")), F.lit(f" — {applicant}"))
    return own.select("job_id", mail(F.col("recipient")).alias("recipient"), mail(subject).alias("subject"), mail(F.col("body")).alias("body"), mail(F.col("_c.path")).alias("resume"), mail(F.col("_c.name")).alias("profile"), mail(F.col("_path")).alias("attachment"), mail(F.left("body", F.lit(400))).alias("preview"), F.when(~ok, "no address").alias("error"))


def tally(df: DataFrame, outcome: str) -> DataFrame:
    """sent, failed, waiting and queued (what no outcome has yet, never below 0) of apply outcomes."""
    c = lambda v: F.count_if(F.col(outcome) == v)
    got = df.agg(c("sent").alias("sent"), c("failed").alias("failed"), c("waiting").alias("waiting"), F.count("*").alias("n"))
    return got.select("sent", "failed", "waiting", F.greatest(F.lit(0), F.col("n") - F.col("sent") - F.col("failed") - F.col("waiting")).alias("queued"))


def apply_plan(jobs: DataFrame, companies: DataFrame, registry: DataFrame, now: Column, hours: int) -> DataFrame:
    """(id, url, route, source, retry_at): where each posting's application goes, as rows of an outbox.

    Route 'email' with an address; else 'source' by the board's name, the company, or the board of the posting's host, in
    this order; else 'fail'. jobs: id, company_id, url, hr_email, aggregator_name; companies: id, name; registry: pos, name, source_url.
    """
    named = registry.groupBy(F.col("name").alias("_board")).agg(F.lit(True).alias("_known"))
    byhost = board_by_host(jobs.select("id", "url"), registry).select(F.col("id").alias("_id"), "board")
    got = jobs.join(named, F.col("aggregator_name") == F.col("_board"), "left")
    got = got.join(companies.select(F.col("id").alias("_c"), F.col("name").alias("_company")), F.col("company_id") == F.col("_c"), "left")
    got = got.join(byhost, F.col("id") == F.col("_id"), "left")
    source = F.coalesce("_board", "_company", "board")
    route = F.when(F.trim(F.coalesce("hr_email", F.lit(""))) != "", "email").when(source.isNotNull(), "source").otherwise("fail")
    return got.select("id", "url", route.alias("route"), source.alias("source"), (now + F.make_interval(hours=F.lit(hours))).alias("retry_at"))
