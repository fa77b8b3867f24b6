"""Pages as a source: addresses are fetched on the executors by a getter that the caller plugs in.

The library opens no connection by itself but through ``http_getter``; any callable that takes an address and
returns (status, headers, body) will do, such as a browser's or a test's. A failure is a row, never a failed task.
"""

from __future__ import annotations

import heapq
import itertools
import random
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.errors import RETRY_STATUS

SCHEMA = "url string, status int, headers map<string, string>, html string, attempts int, error string"


class Getter(Protocol):
    """What fetches one address; raises for what has no response."""

    def __call__(self, url: str) -> tuple[int, dict[str, str], str]: ...


@dataclass(frozen=True)
class Client:
    """Limits of each host: requests a second, how many may come at once, tries, and waits between tries."""

    # The defaults of a source without a client of its own.
    rate: float = 1.5
    burst: int = 4
    attempts: int = 4
    least_ms: float = 200.0
    most_ms: float = 2000.0
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)
    clock: Callable[[], float] = field(default=time.monotonic, compare=False)
    chance: Callable[[], float] = field(default=random.random, compare=False)

    def pause(self, attempt: int, headers: Mapping[str, str]) -> float:
        """Seconds before the next try: what the response asks for, and a random share of a bound that doubles with each try."""
        asked = next((v for k, v in headers.items() if k.lower() == "retry-after"), "").strip()
        return asked_seconds(asked, datetime.now(timezone.utc)) + self.chance() * min(self.most_ms, self.least_ms * 2 ** (attempt - 1)) / 1000

    def in_turn(self, addresses: Iterable[str | None]) -> Iterator[tuple[str | None, Callable[[], None]]]:
        """(address, what to call before each request of it) of WINDOW addresses at a time: always one whose host may be asked soonest.

        A host's requests keep to ``rate`` after the first ``burst``; while one waits others go on. What is held is the window and one
        number for each host that was asked within its last burst.
        """
        due: dict[str, float] = {}  # when a host's tokens are full again
        gap, addresses = 1 / self.rate, iter(addresses)
        while window := list(itertools.islice(addresses, WINDOW)):
            now = self.clock()
            due = {h: t for h, t in due.items() if t > now}
            of: dict[str, deque] = {}
            for a in window:
                of.setdefault(host_of(a), deque()).append(a)
            free = lambda h: due.get(h, 0.0) - (self.burst - 1) * gap
            queue = [(free(h), k, h) for k, h in enumerate(of)]
            heapq.heapify(queue)
            while queue:
                _, k, h = heapq.heappop(queue)

                def wait(h: str = h) -> None:
                    ahead = free(h) - self.clock()
                    if ahead > 0:
                        self.sleep(ahead)
                    due[h] = max(self.clock(), due.get(h, 0.0)) + gap

                yield of[h].popleft(), wait
                if of[h]:
                    heapq.heappush(queue, (free(h), k, h))


#: Addresses that a task looks ahead for hosts that may be asked.
WINDOW = 1000


def host_of(address: str | None) -> str:
    try:
        return (urlsplit((address or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def asked_seconds(value: str, now: datetime) -> float:
    """Seconds that a Retry-After header asks for, as ``errors.retry_after`` has them: a positive number, or a date within ten minutes; else 0."""
    if re.fullmatch(r"\+?[0-9]+", value):
        return float(value)
    try:
        ahead = (parsedate_to_datetime(value) - now).total_seconds()
    except (TypeError, ValueError):
        return 0.0
    return ahead if 0 < ahead < 600 else 0.0


def _late(e: Exception) -> bool:
    return isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError) or "Client.Timeout exceeded" in str(e)


def http_getter(timeout: float = 15.0, agent: str = "Mozilla/5.0") -> Getter:
    """Plain GET by the standard library; a status that is no success is a response like any other."""

    def get(url: str) -> tuple[int, dict[str, str], str]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.status, dict(r.headers), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except HTTPError as e:
            return e.code, dict(e.headers), ""

    return get


def one(url: str | None, getter: Getter, client: Client, wait: Callable[[], None]) -> tuple:
    """The row of one address: a status that may pass and a failed connection are tried again, a timeout isn't."""
    if not (url or "").strip():
        return url, None, [], None, 0, "no address"
    status, headers, body, error, n = None, {}, None, None, 0
    for n in range(1, client.attempts + 1):
        wait()
        try:
            status, headers, body = getter(url)
            error = None if 200 <= status < 300 else f"http {status}"
            again = status in RETRY_STATUS
        except Exception as e:  # any failure of one address is that row's error
            status, headers, body, again = None, {}, None, not _late(e)
            error = (str(e) or type(e).__name__) if again else "context deadline exceeded"
        if error is None or not again or n == client.attempts:
            break
        client.sleep(client.pause(n, headers))
    return url, status, list(headers.items()), body if error is None else None, n, error


_ARROW = pa.schema([("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("html", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])


def batches_of(addresses: Iterable[str | None], getter: Getter, client: Client, rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Record batches of SCHEMA, of ``rows`` pages each, so that a task holds no more of them."""
    got = (one(a, getter, client, wait) for a, wait in client.in_turn(addresses))
    while some := list(itertools.islice(got, rows)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def fetch(urls: DataFrame, getter: Getter, client: Client = Client(), url: str = "url") -> DataFrame:
    """(url, status, headers, html, attempts, error) of each address; those of one host meet in one task, so its limits hold.

    ``html`` is null and ``error`` says why where there is no success. A null or blank address is an error of its own. A host with a
    large share of the addresses makes a long task: its rate allows no second one.
    """

    def run(batches):
        yield from batches_of((u for b in batches for u in b.column("url").to_pylist()), getter, client)

    own = urls.select(F.col(url).cast("string").alias("url"))
    return own.repartition(U.host_of(F.coalesce("url", F.lit("")))).mapInArrow(run, SCHEMA)


def from_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The same from pages (url, html) fetched before; an address that isn't among them is an error."""
    own = pages.groupBy(F.col("url").alias("_u")).agg(F.min("html").alias("html"))
    got = urls.select("url").join(own, F.col("url") == F.col("_u"), "left")
    there = F.col("_u").isNotNull()
    return got.select("url", F.when(there, 200).alias("status"), F.expr("cast(map() as map<string, string>)").alias("headers"), "html", F.lit(1).alias("attempts"), F.when(~there, "not fetched").alias("error"))


def good(fetched: DataFrame) -> DataFrame:
    """(url, html) of what came without an error; rows with one go before anything is parsed."""
    return fetched.where("error is null").select("url", "html")
