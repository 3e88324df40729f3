"""Structured Streaming: keyed conversation state, incremental extraction, and a bounded crawl."""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from loomspark.functions.html import page
from loomspark.functions.url import is_document, is_page, normalize_url, should_visit, visit_key
from loomspark.operators.visited import Visited
from loomspark.storage import dealt_out, written


def running_history(messages: DataFrame, n: int = 10, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, turn, role, content) -> (session_id, turn, history): the n messages before each one, by turn.

    State is a session's last n messages and the turn of its last ``cleared`` event. A message that comes late takes its
    place by turn, as far as the state still reaches; one that repeats a turn in the state, or has the turn of a clear
    event that is known or an earlier one, gives no row. Events of a batch count in order of turns, a clear event
    before a message of the same turn; it gives no row, and takes out what came before it. With
    idle_ms a session without messages for that long is forgotten; state never holds more than n messages.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, lines, cut = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        out = []
        rows = pd.concat(list(batches))
        for r in rows.assign(said=rows["role"] != "cleared").sort_values(["turn", "said"], kind="stable").itertuples():
            turn = int(r.turn)
            if r.role == "cleared":
                cut = turn if cut is None else max(cut, turn)
                first = bisect_right(turns, cut)
                del turns[:first], lines[:first]
                continue
            at = bisect_left(turns, turn)
            if (cut is not None and turn <= cut) or turns[at : at + 1] == [turn]:
                continue
            out.append((key[0], turn, "\n".join(lines[max(0, at - n) : at]) or "(No previous conversation)"))
            turns.insert(at, turn)
            lines.insert(at, ("User: " if r.role == "user" else "Assistant: ") + (r.content or ""))
            del turns[:-n], lines[:-n]
        state.update((turns, lines, cut))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "turn", "history"])

    kept = messages.filter("session_id is not null and turn is not null")
    return kept.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn long, history string", "turns array<long>, lines array<string>, cut long", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def incremental_extraction(chunks: DataFrame, extract_batch: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str):  # noqa: ANN201
    """Start a query that extracts only chunks whose text the cache does not hold; ends when the input is used up."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])
        try:
            new = new.join(spark.read.parquet(cache_path).filter("status <> 'failed'").select("content_hash"), "content_hash", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        extract_batch(new).write.mode("append").parquet(cache_path)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(urls: DataFrame, fetch: Callable[[str], str | None], delay: float = 2.0) -> DataFrame:
    """(url, html) of urls(url, domain): each domain is one task that waits between requests."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in batches:
            html = []
            for r in pdf.itertuples():
                time.sleep(max(0.0, last.get(r.domain, -1e9) + delay - time.monotonic()))
                last[r.domain] = time.monotonic()
                html.append(fetch(r.url))
            yield pd.DataFrame({"url": pdf["url"], "html": html})

    return urls.repartition("domain").select("url", "domain").mapInPandas(get, "url string, html string")


def crawl(spark: SparkSession, start: list[str], pages: DataFrame, domain: str, max_depth: int = 2, max_pages: int = 500) -> tuple[DataFrame, DataFrame]:
    """(pages with content, document links) by breadth-first search over pages(url, html[, content_type]), the offline web.

    Seeds and links are visited if should_visit() says so, once, by their lower-cased normalised URL; seeds
    and links that are documents are listed instead. Responses that are no HTML are passed over. Links are
    followed below max_depth. Only pages with three blocks or a FAQ count toward max_pages.
    """
    web = pages if "content_type" not in pages.columns else pages.filter(is_page(F.col("content_type")))
    web = web.withColumn("key", visit_key(F.col("url")))
    seeds = spark.createDataFrame([(u,) for u in start], "url string")
    frontier = seeds.filter(should_visit(F.col("url"), F.lit(domain))).select(visit_key(F.col("url")).alias("key")).distinct()
    documents = seeds.filter(is_document(F.col("url"))).select(F.col("url").alias("document"))
    seen, kept, budget = Visited(spark), None, max_pages
    frontier = written(frontier, "crawl-frontier")
    for depth in range(max_depth + 1):
        got = written(web.join(frontier, "key", "left_semi").withColumn("page", page("html", "url", fields=("title", "chunks", "faqs", "links", "documents"))), "crawl")
        good = got.filter((F.size("page.chunks") >= 3) | (F.size("page.faqs") >= 1)).orderBy("key").limit(budget).select("url", F.lit(depth).alias("depth"), "page")
        good = written(good, "crawl-kept")
        kept = good if kept is None else kept.unionByName(good)
        links = got.select(F.explode("page.documents").alias("document")).distinct()
        documents = documents.union(links).distinct()
        budget -= good.count()
        if budget <= 0 or depth == max_depth:
            break
        seen.add(frontier)
        found = got.select(F.explode("page.links").alias("url")).filter(should_visit(F.col("url"), F.lit(domain)))
        frontier = written(seen.unseen(found.select(visit_key(normalize_url(F.col("url"))).alias("key"))), "crawl-frontier")
        if frontier.isEmpty():
            break
    seen.close()
    return kept, documents


def crawl_statistics(kept: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: pages, documents, faqs of a crawl."""
    pages = kept.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("page.faqs")), F.lit(0)).alias("faqs"))
    return pages.join(documents.agg(F.countDistinct("document").alias("documents")), how="cross").select("pages", "documents", "faqs")  # one row each


def scrape_list(catalogue: DataFrame, web: DataFrame, done: DataFrame | None = None, full: bool = False) -> DataFrame:
    """catalogue(category, subcategory, name, url) over web(url, html) -> (category, subcategory, name, url, status, markdown).

    status: ``exists`` for names that done(category, subcategory, name) holds, which are not fetched; ``failed``
    without a page; ``saved``; with full, the full Markdown form, and ``skipped`` if it is too short.
    """
    key = ["category", "subcategory", "name"]
    known = catalogue if done is None else catalogue.join(done.select(*key).distinct().withColumn("held", F.lit(True)), key, "left")
    held = F.lit(False) if done is None else F.coalesce("held", F.lit(False))
    # by number and merged: a web whose size is guessed from the table it is made of would be sent to every task, and few tasks would read it
    pages = dealt_out(known.withColumn("exists", held), "url").join(web.select("url", "html").hint("merge"), "url", "left").withColumn("html", F.when(~F.col("exists"), F.col("html")))
    name = "full_markdown" if full else "markdown"
    form = page("html", "url", fields=(name,))[name]
    text = F.when(F.col("html").isNotNull(), form)
    status = F.when(F.col("exists"), "exists").when(F.col("html").isNull(), "failed").when(F.col("markdown").isNull(), "skipped").otherwise("saved")
    return pages.withColumn("markdown", text).select(*key, "url", status.alias("status"), "markdown")


def scrape_counts(scraped: DataFrame) -> DataFrame:
    """(category, subcategory, total, completed): what exists or was saved is completed."""
    return scraped.groupBy("category", "subcategory").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("exists", "saved")).alias("completed"))
