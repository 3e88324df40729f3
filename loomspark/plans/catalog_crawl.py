"""Registered queries over polite fetching and the visited table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.url import visit_key
from loomspark.operators.visited import Visited
from loomspark.plans.catalog import query, table
from loomspark.storage import fresh_path, written
from loomspark.streaming.fetch import Manners, Response, fetch_all, request_log, shortest_gaps

#: Short delays, so that thousands of requests end soon; some hosts have hundreds.
MANNERS = Manners(delay=0.01, attempts=2, pause=0.02, round_requests=200)
MOVED = "http://moved.example.net/#"


def _answer(url: str) -> Response:
    """An offline web: what comes back follows from the page's number at the end of its address."""
    n = int(url.rpartition("#")[2])
    if url.startswith(MOVED):
        return Response(200, f"got {n}")
    if n % 11 == 0:
        return Response(503)
    if n % 7 == 0:
        return Response(301, location=f"{MOVED}{n}")
    return Response(404, "no") if n % 5 == 0 else Response(200, f"got {n}")


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("url is not null").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "page_id")


ASKED = (
    "asked as (select url || '#' || page_id as url, page_id % 11 = 0 as broken, page_id % 7 = 0 and page_id % 11 <> 0 as moved, page_id % 5 = 0 as missing, page_id from pages where url is not null)"
)


@query(f"with {ASKED} select url, case when moved then '{MOVED}' || page_id else url end as final_url, case when broken then 503 when moved then 200 when missing then 404 else 200 end as status, case when moved then 1 else 0 end as hops, case when broken or moved then 2 else 1 end as requests, case when moved or not broken and not missing then 'got ' || page_id end as body from asked")
def t2_fetched(spark, d):  # noqa: ANN001, ANN201
    """Every page address: failures are tried twice, redirects all lead to one host."""
    return fetch_all(_addresses(spark, d).select("url"), _answer, fresh_path(spark, "requests"), MANNERS).drop("content_type")


@query(f"with {ASKED}, req as (select lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) as domain, case when broken then 2 else 1 end as n from asked union all select 'moved.example.net', 1 from asked where moved) select domain, sum(n)::bigint as requests, true as kept from req group by 1")
def t2_request_gaps(spark, d):  # noqa: ANN001, ANN201
    """Two runs over one log, the second of all addresses: nothing is asked again, and no two requests of a domain come closer than the delay."""
    urls, path = _addresses(spark, d), fresh_path(spark, "requests")
    fetch_all(urls.filter("page_id % 2 = 0").select("url"), _answer, path, MANNERS)
    fetch_all(urls.select("url"), _answer, path, MANNERS)
    kept = F.coalesce(F.col("gap") >= MANNERS.delay * 0.999, F.lit(True))  # times are doubles
    return shortest_gaps(request_log(spark, path)).select("domain", "requests", kept.alias("kept"))


@query("with k as (select distinct page_id % 4 as batch, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) as key from pages where url is not null) select key, min(batch)::int as batch from k group by 1")
def u4_visited_batches(spark, d):  # noqa: ANN001, ANN201
    """Page addresses in four batches, each of them asked for what no earlier one had."""
    pages, seen, out = table(spark, d, "pages"), Visited(spark), None
    for batch in range(4):
        keys = pages.filter(F.col("page_id") % 4 == batch).select(visit_key(F.col("url")).alias("key"))
        new = written(seen.unseen(keys), "unseen")
        seen.add(new)
        rows = new.select("key", F.lit(batch).alias("batch"))
        out = rows if out is None else out.unionByName(rows)
    seen.close()
    return out
