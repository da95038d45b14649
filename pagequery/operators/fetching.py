"""Pages by URL: from a table of pages already fetched, else from a fetcher the caller brings."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.errors import FetchError
from pagequery.functions.pages import host, looks_challenged, meaningful, metadata

PAGE = "url string, html string, status int, headers map<string,string>, tier int, fetched_at timestamp, error string"


@dataclass
class Fetched:
    """What a fetcher gives back for a URL."""

    html: str
    status: int = 200
    headers: dict[str, str] = field(default_factory=dict)


#: A fetcher of one tier: the page of a URL; TimeoutError and other errors are recorded.
Fetcher = Callable[[str], Fetched]


def latest_cached(cache: DataFrame, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The last page of each URL, none that is older than ``ttl_seconds``; of two at the same time the one with the smaller hash of its markup."""
    fresh = cache if ttl_seconds is None else cache.where(F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros("fetched_at") <= ttl_seconds * 1_000_000)
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.sha2(F.coalesce("html", F.lit("")), 256))
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_tier(tier: Column, status: Column, error: Column, html: Column, title: Column, headers: Column) -> Column:
    """The tier that a result calls for, null where it stands.

    Refusals (403, 429, 503) and timeouts below tier 2 call for the next tier,
    a bot check for tier 3, and a page of tier 0 or 1 with too little text for
    tier 2. Other errors stand.
    """
    refused = status.isin(403, 429, 503) | F.coalesce(error.startswith("TimeoutError"), F.lit(False))
    thin = error.isNull() & ~F.coalesce(meaningful(F.coalesce(html, F.lit(""))), F.lit(False))
    return F.when((tier < 3) & error.isNull() & looks_challenged(title, headers), 3).when((tier < 2) & refused, tier + 1).when((tier < 2) & thin, 2)


class HttpFetcher:
    """A plain GET: redirects are followed, the charset is that of the headers, else UTF-8. A status that says failure is a result, as is its page."""

    def __init__(self, headers: dict[str, str] | None = None, timeout_seconds: float = 30.0, max_bytes: int = 10_000_000):
        self.headers, self.timeout, self.max_bytes = headers or {}, timeout_seconds, max_bytes

    def __call__(self, url: str) -> Fetched:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        if not url.lower().startswith(("http://", "https://")):
            raise FetchError("only http and https are fetched", url=url)
        try:
            answer = urlopen(Request(url, headers=self.headers), timeout=self.timeout)
        except HTTPError as e:
            answer = e
        with answer:
            body = answer.read(self.max_bytes + 1)
            if len(body) > self.max_bytes:
                raise FetchError("the page is too large", url=url, max_bytes=self.max_bytes)
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                text = body.decode(charset, "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            return Fetched(text, answer.status, dict(answer.headers.items()))


class Pace:
    """When the next request to a host may go: a host's own interval and that of all hosts together, each stretched by up to the share ``jitter``."""

    def __init__(self, per_second: float, global_per_second: float, shares: int, tasks: int, jitter: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.own = shares / per_second if per_second > 0 else 0.0
        self.all = tasks / global_per_second if global_per_second > 0 else 0.0
        self.shares, self.jitter, self.clock, self.sleep = shares, jitter, clock, sleep
        self.next_of: dict[str, float] = {}
        self.next = 0.0

    def wait(self, name: str, delay: float | None = None) -> float:
        """Waits for a turn, and says how long; ``delay`` is the host's own wish (Crawl-delay)."""
        wait = max(0.0, self.next_of.get(name, 0.0) - self.clock(), self.next - self.clock())
        if wait > 0:
            wait *= 1 + random.uniform(0, self.jitter)
            self.sleep(wait)
        now = self.clock()
        self.next_of[name] = now + max(self.own, (delay or 0.0) * self.shares)
        self.next = now + self.all
        return wait


def fetch(
    urls: DataFrame, tiers: dict[int, Fetcher], cache: DataFrame | None = None, ttl_seconds: int | None = None, per_second: float = 2.0,
    global_per_second: float = 0.0, jitter: float = 0.0, delays: DataFrame | None = None, shares: int = 1, tasks: int = 8,
) -> DataFrame:
    """Pages of ``urls`` (url): from the cache where it has them, else by tier, lowest first, until a result stands.

    Repeats and null URLs are left out. A host's URLs are dealt to ``shares`` of
    ``tasks`` tasks, each of which holds its share of the host's rate, so a host
    of many URLs can be spread without exceeding it; ``global_per_second`` holds
    over all hosts. ``delays`` (host, delay) are the seconds that hosts ask for
    between requests (``loose.crawl_delay`` of their robots file). A failed URL
    keeps its row, with ``error``. Fetchers must be picklable; they run on the
    executors.
    """
    wanted = urls.select("url").where("url IS NOT NULL").distinct()
    if cache is not None:
        kept = latest_cached(cache, ttl_seconds=ttl_seconds).withColumn("_hit", F.lit(True))
        found = wanted.join(kept, "url", "left")
        hits, wanted = found.where("_hit").drop("_hit"), found.where("_hit IS NULL").select("url")
    def ask(fetcher: Fetcher, tier: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = Pace(per_second, global_per_second, shares, tasks, jitter)
            for part in parts:
                out = []
                for url, name, delay in zip(part["url"], part["_host"], part["_delay"]):
                    pace.wait(name, None if pd.isna(delay) else float(delay))
                    try:
                        got, error = fetcher(url), None
                    except Exception as e:  # any failure of a fetch is a result, not the job's end
                        got, error = Fetched("", 0), f"{type(e).__name__}: {e}"
                    out.append((url, got.html, got.status, got.headers, tier, pd.Timestamp.now("UTC"), error))
                yield pd.DataFrame(out, columns=["url", "html", "status", "headers", "tier", "fetched_at", "error"])

        return run

    def at_tier(rows: DataFrame, tier: int) -> DataFrame:
        placed = rows.withColumn("_host", host(F.col("url")))
        if delays is None:
            placed = placed.withColumn("_delay", F.lit(None).cast("double"))
        else:
            placed = placed.join(delays.select(F.lower("host").alias("_host"), F.col("delay").cast("double").alias("_delay")), "_host", "left")
        spread = placed.select("url", "_host", "_delay").repartition(tasks, F.col("_host"), F.pmod(F.xxhash64("url"), F.lit(shares)))
        return spread.mapInPandas(ask(tiers[tier], tier), PAGE)

    from pagequery.operators.crawl import written

    done, todo = [], wanted
    for tier in sorted(tiers):
        got = written(at_tier(todo, tier))  # a fetch must not run again when a later step needs its rows
        later = F.coalesce(next_tier(F.col("tier"), F.col("status"), F.col("error"), F.col("html"), metadata(F.col("html"))["title"], F.col("headers")), F.lit(0))
        judged = got.withColumn("_next", later)
        higher = [t for t in tiers if t > tier]
        if not higher:
            done.append(got)
            break
        done.append(judged.where(F.col("_next") <= tier).drop("_next"))
        todo = judged.where(F.col("_next") > tier).select("url")
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out.unionByName(hits, allowMissingColumns=True).select(*out.columns) if cache is not None else out
