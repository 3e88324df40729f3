"""Polite fetching of many addresses: a slot for each request of a domain, retries, redirects, and a log to go on from.

The slots of a domain are a window over its open requests; a task takes the requests of its domains in order of slots,
so that it waits for one domain only while none of the others is due. What was requested, and when, is appended
to a log after each round. A run reads from it what is open and when a domain was last asked, so a run that
was stopped goes on where the last whole round ended. Rounds double, so that their number, and how often the log
is read, grows with the logarithm of a domain's requests.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from itertools import count
from urllib.parse import urljoin

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.url import authority
from loomspark.sources.store import read_if_any
from loomspark.storage import written

#: Statuses that name another address, and those that are worth another attempt (0: no answer).
MOVED = (301, 302, 303, 307, 308)
AGAIN = (0, 408, 429, 500, 502, 503, 504)
#: Answers that a task holds before it hands them on.
HELD = 64
LOG = "url string, domain string, target string, hop int, attempt int, requested_at double, status int, content_type string, location string, body string"


@dataclass(frozen=True)
class Response:
    """An answer: status, text, content type, and where it sends to. A fetcher that has none gives None."""

    status: int
    body: str | None = None
    content_type: str = "text/html"
    location: str | None = None


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):  # noqa: ANN002, ANN201
        return None


def http_fetch(headers: dict[str, str] | None = None, timeout: float = 30.0) -> Callable[[str], Response | None]:
    """A fetcher over HTTP with these headers; redirects are not followed but given back, for each is a request of its own."""

    def fetch(url: str) -> Response | None:
        opener = urllib.request.build_opener(_Stay)
        try:
            with opener.open(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                charset = r.headers.get_content_charset() or "utf-8"
                return Response(r.status, r.read().decode(charset, "replace"), r.headers.get("Content-Type", ""))
        except urllib.error.HTTPError as e:
            return Response(e.code, None, e.headers.get("Content-Type", ""), e.headers.get("Location"))
        except (OSError, ValueError, LookupError):
            return None

    return fetch


@dataclass(frozen=True)
class Manners:
    """Seconds between requests of a domain; attempts of an address and the first pause before another; redirects followed; requests of a domain in the first round of a run."""

    delay: float = 2.0
    attempts: int = 3
    pause: float = 5.0
    redirects: int = 10
    round_requests: int = 1000


def open_requests(urls: DataFrame, log: DataFrame | None, manners: Manners) -> DataFrame:
    """(url, domain, target, hop, attempt, due): what is still to be asked of urls(url), given the log.

    New addresses, the targets of redirects, and failures with attempts left, each pause twice the one before. Null addresses and
    repeated ones give nothing more; an address without a host is a domain of its own, the empty one.
    """
    wanted = urls.select("url").filter("url is not null").distinct()
    first = wanted.select("url", F.col("url").alias("target"), F.lit(0).alias("hop"), F.lit(1).alias("attempt"), F.lit(0.0).alias("due"))
    if log is not None:
        row = F.struct("hop", "attempt", "target", "requested_at", "status", "location")
        last = wanted.join(log.groupBy("url").agg(F.max(row).alias("x")), "url").select("url", "x.*")
        moved = last.filter(F.col("status").isin(*MOVED) & F.col("location").isNotNull() & (F.col("hop") < manners.redirects))
        failed = last.filter(F.col("status").isin(*AGAIN) & (F.col("attempt") < manners.attempts))
        pause = F.lit(manners.pause) * F.pow(F.lit(2.0), F.col("attempt") - 1)
        first = first.join(log.select("url").distinct(), "url", "left_anti")
        first = first.unionByName(moved.select("url", F.col("location").alias("target"), (F.col("hop") + 1).alias("hop"), F.lit(1).alias("attempt"), F.lit(0.0).alias("due")))
        first = first.unionByName(failed.select("url", "target", "hop", (F.col("attempt") + 1).alias("attempt"), (F.col("requested_at") + pause).alias("due")))
    return first.withColumn("domain", authority(F.col("target")))


def slots(requests: DataFrame, log: DataFrame | None, manners: Manners, now: float) -> DataFrame:
    """requests with ``slot``, seconds after now: in order of (due, url), none before it is due, and delay after the one before, the log's too.

    With d_j the time request j is due, request k starts at the largest of d_j + (k - j) * delay, j up to k: a running maximum.
    """
    at = requests
    free = F.lit(0.0)
    if log is not None:
        at = at.join(log.groupBy("domain").agg((F.max("requested_at") + manners.delay).alias("free")), "domain", "left")
        free = F.coalesce("free", F.lit(0.0))
    w = Window.partitionBy("domain").orderBy("due", "url")
    at = at.withColumn("k", F.row_number().over(w) - 1).filter(F.col("k") < manners.round_requests)
    least = F.greatest(F.col("due"), free, F.lit(now)) - F.lit(now)
    ahead = F.max(least - F.col("k") * manners.delay).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("slot", ahead + F.col("k") * manners.delay).select("url", "domain", "target", "hop", "attempt", "slot")


def _asked(fetch: Callable[[str], Response | None], manners: Manners, threads: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The work of a task: requests by slot, at most ``threads`` at once."""

    def ask(target: str) -> Response:
        try:
            return fetch(target) or Response(0)
        except Exception:  # noqa: BLE001  a fetcher that fails is an address without an answer
            return Response(0)

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # An attempt of a task that was lost may have asked just now.
        start = time.time() + (manners.delay if TaskContext.get().attemptNumber() else 0.0)
        last: dict[str, float] = {}
        waiting: dict[Future, tuple] = {}
        out: list[tuple] = []

        def collect(least: int) -> None:
            while len(waiting) > least:
                for f in wait(waiting, return_when=FIRST_COMPLETED).done:
                    r, began = waiting.pop(f)
                    a = f.result()
                    out.append((r.url, r.domain, r.target, r.hop, r.attempt, began, a.status, a.content_type, urljoin(r.target, a.location) if a.location else None, a.body))

        frame = lambda: pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                for r in pdf.itertuples():
                    collect(threads - 1)  # a free thread starts at once
                    due = max(start + r.slot, last.get(r.domain, 0.0) + manners.delay)
                    time.sleep(max(0.0, due - time.time()))
                    began = last[r.domain] = time.time()
                    waiting[pool.submit(ask, r.target)] = (r, began)
                    if len(out) >= HELD:
                        yield frame()
                        out.clear()
            collect(0)
        yield frame()

    return get


def fetch_all(urls: DataFrame, fetch: Callable[[str], Response | None], path: str, manners: Manners | None = None, threads: int = 8) -> DataFrame:
    """Ask for urls(url) until all have a last answer; the log at path. Returns outcomes() of these.

    The first round takes at most round_requests of each domain, each further one twice as many as the one before. A domain's requests
    of a round are one task's, for their times depend on each other, and there are no more tasks than cores: a task in a
    second wave would let its domains wait for those of the first. A lost task asks again for what it had; speculative execution would ask twice. Times of different
    executors are compared, so clocks should agree to less than the delay. With an empty table nothing is asked.
    """
    manners = manners or Manners()
    spark = urls.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for r in count():
        log = read_if_any(spark, path)
        todo = written(open_requests(urls, log, manners), "open-requests")
        if todo.isEmpty():
            break
        planned = slots(todo, log, replace(manners, round_requests=manners.round_requests << min(r, 32)), time.time()).repartition(tasks, "domain").sortWithinPartitions("slot")
        planned.mapInPandas(_asked(fetch, manners, threads), LOG).write.mode("append").parquet(path)
    return outcomes(urls, request_log(spark, path))


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """All requests: url asked for, domain and target of the request, hop, attempt, when, status, content type, location, body."""
    log = read_if_any(spark, path)
    return spark.createDataFrame([], LOG) if log is None else log


def outcomes(urls: DataFrame, log: DataFrame) -> DataFrame:
    """(url, final_url, status, hops, requests, content_type, body) of each address with an answer: its last one; body null unless the status is 2xx."""
    last = F.max(F.struct("hop", "attempt", "requested_at", "target", "status", "content_type", "body")).alias("x")
    found = log.join(urls.select("url").distinct(), "url", "left_semi").groupBy("url").agg(last, F.count("*").alias("requests"))
    good = F.col("x.status").between(200, 299)
    return found.select("url", F.col("x.target").alias("final_url"), F.col("x.status").alias("status"), F.col("x.hop").alias("hops"), "requests", "x.content_type", F.when(good, F.col("x.body")).alias("body"))


def shortest_gaps(log: DataFrame) -> DataFrame:
    """(domain, requests, gap): the least seconds between two requests of a domain; null for one request."""
    gap = F.col("requested_at") - F.lag("requested_at").over(Window.partitionBy("domain").orderBy("requested_at"))
    return log.select("domain", gap.alias("gap")).groupBy("domain").agg(F.count("*").alias("requests"), F.min("gap").alias("gap"))
