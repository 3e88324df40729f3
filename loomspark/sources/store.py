"""Persisted tables: the graph, communities, merged extractions, caches, vector index, page files, downloads and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import truncate
from loomspark.functions.url import download_name, page_name
from loomspark.operators.graph import Graph
from loomspark.storage import written


def save_graph(graph: Graph, path: str) -> None:
    for name in ("nodes", "edges", "entity_map"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "entity_map")))


def save_extractions(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """The merged entities and relationships as named tables."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relationships.write.mode("overwrite").parquet(f"{path}/relationships")


def load_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relationships")


COMMUNITY = "id string, level int, entity_ids array<string>, title string, summary string, parent_id string, child_ids array<string>"


def community_rows(members: DataFrame, titles: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """members(level, community, node_id, parent), titles(level, community, title) -> one row for each community, as COMMUNITY.

    Members and children are in order of their name; without summaries(level, community, summary) it is empty.
    """
    own = members.groupBy("level", F.col("community").alias("id")).agg(F.array_sort(F.collect_set("node_id")).alias("entity_ids"), F.max("parent").alias("parent_id"))
    below = members.filter("parent is not null").groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("community")).alias("child_ids"))
    out = own.join(below, ["level", "id"], "left").join(titles.select("level", F.col("community").alias("id"), "title"), ["level", "id"], "left")
    if summaries is None:
        out = out.withColumn("summary", F.lit(""))
    else:
        out = out.join(summaries.select("level", F.col("community").alias("id"), "summary"), ["level", "id"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return out.select("id", "level", "entity_ids", "title", "summary", "parent_id", F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))


def save_communities(communities: DataFrame, path: str) -> None:
    communities.write.mode("overwrite").parquet(path)


def load_communities(spark: SparkSession, path: str) -> DataFrame:
    """Communities as COMMUNITY; a table without summaries yet has empty ones."""
    return spark.read.schema(COMMUNITY).parquet(path)


def list_communities(communities: DataFrame, length: int = 300) -> DataFrame:
    """(id, level, title, num_entities, summary): summaries longer than length are cut and end with dots."""
    return communities.select("id", "level", "title", F.size("entity_ids").alias("num_entities"), truncate(F.coalesce("summary", F.lit("")), length, "...").alias("summary"))


def write_json(df: DataFrame, path: str) -> None:
    """Interchange form: one JSON file, nulls kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cache_lookup(chunks: DataFrame, cache: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): by hash of the text and provider version; failed rows are not hits."""
    keyed = chunks.withColumn("content_hash", F.sha2("text", 256))
    good = cache.filter((F.col("status") != "failed") & (F.col("provider") == provider)).select("content_hash", "parsed").dropDuplicates(["content_hash"])
    return keyed.join(good, "content_hash"), keyed.join(good.select("content_hash"), "content_hash", "left_anti")


def cache_append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def cache_upsert(rows: DataFrame, path: str, key: str = "content_hash", failures: bool = True) -> None:
    """Append rows whose key the cache at path does not hold as a success; failed ones (status ``failed``) only if failures, and once.

    A success replaces a failure of the same key for readers, since cache_lookup() passes over failures.
    """
    keep_failures = failures and "status" in rows.columns
    new = rows.dropDuplicates([key])
    if "status" in rows.columns:  # of repeated rows the success counts
        good, bad = rows.filter("status <> 'failed'").dropDuplicates([key]), rows.filter("status = 'failed'").dropDuplicates([key])
        new = good.unionByName(bad.join(good.select(key), key, "left_anti").select(rows.columns)) if keep_failures else good
    held = read_if_any(rows.sparkSession, path)
    if held is not None:
        known = held.filter("status <> 'failed'") if "status" in held.columns else held
        todo = new.join(known.select(key).distinct(), key, "left_anti").select(rows.columns)
        if keep_failures:
            todo = todo.filter("status <> 'failed'").unionByName(todo.filter("status = 'failed'").join(held.select(key).distinct(), key, "left_anti").select(rows.columns))
        new = todo
    cache_append(written(new, "cache-rows"), path)


def summary_upsert(summaries: DataFrame, path: str) -> None:
    """Append (context_hash, community, summary) of summaries that the cache at path does not hold; empty ones are failures and stay out."""
    good = summaries.filter(F.trim(F.coalesce("summary", F.lit(""))) != "").select("context_hash", "community", "summary")
    cache_upsert(good, path, "context_hash", failures=False)


def cache_delete(cache: DataFrame, chunk_ids: DataFrame, dry_run: bool = False) -> DataFrame:
    """The cache without these chunks; with dry_run, the rows that would go."""
    return cache.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi" if dry_run else "left_anti")


def build_index(summaries: DataFrame, embed, path: str) -> None:  # noqa: ANN001
    """The vector index: non-empty summaries with their embedding (a Column -> Column provider) and a fingerprint."""
    rows = summaries.filter(F.coalesce("summary", F.lit("")) != "")
    rows.withColumn("embedding", embed(F.col("summary"))).withColumn("fingerprint", F.sha2("summary", 256)).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str, summaries: DataFrame, embed) -> DataFrame:  # noqa: ANN001
    """The stored index if it holds exactly these summaries, else a new one."""
    want = summaries.filter(F.coalesce("summary", F.lit("")) != "").select(F.sha2("summary", 256).alias("fingerprint"))
    have = read_if_any(spark, path)
    if have is None or not (want.exceptAll(have.select("fingerprint")).isEmpty() and have.select("fingerprint").exceptAll(want).isEmpty()):
        build_index(summaries, embed, path)
    return spark.read.parquet(path)


def page_files(pages: DataFrame) -> DataFrame:
    """pages(url, ...) with file: a safe name, clashes numbered in order of the URL, of equal URLs in order of the other columns."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("url", *[c for c in pages.columns if c != "url"])) - 1
    named = pages.withColumn("name", page_name(F.col("url"))).withColumn("n", n)
    return named.withColumn("file", F.concat("name", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".json"))).drop("name", "n")


def page_json(url: Column, category: Column, page: Column, scraped_at: Column) -> Column:
    """The JSON text of a page as the crawler saves it: source, category, title, scraped_at, text_chunks, faqs (null if none)."""
    faqs = F.when(F.size(page["faqs"]) > 0, page["faqs"])
    return F.to_json(F.struct(url.alias("source"), category.alias("category"), page["title"].alias("title"), scraped_at.alias("scraped_at"), page["chunks"].alias("text_chunks"), faqs.alias("faqs")), {"ignoreNullFields": "false"})


def download_files(documents: DataFrame, most: int = 100) -> DataFrame:
    """documents(url) -> (url, file): the first ``most`` by URL; of equal names all but the first carry a hash of the URL before their ending."""
    first = documents.select("url").distinct().orderBy("url").limit(most).withColumn("name", download_name(F.col("url")))
    n = F.row_number().over(Window.partitionBy("name").orderBy("url"))
    stem, ending = F.regexp_replace("name", r"(?<=.)\.[^.]*\z", ""), F.regexp_extract("name", r".(\.[^.]*)\z", 1)
    marked = F.concat(stem, F.lit("_"), F.left(F.md5(F.col("url").cast("binary")), F.lit(8)), ending)
    return first.withColumn("n", n).select("url", F.when(F.col("n") == 1, F.col("name")).otherwise(marked).alias("file"))


def download(files: DataFrame, fetch: Callable[[str], bytes | None], path: str) -> DataFrame:
    """Fetch files(url, file) in Arrow batches and append (url, file, content) to the table at path; returns (url, file) of those that came.

    Content is a binary column, so any store that Spark writes to holds it. What the table has already is not fetched again.
    """
    spark = files.sparkSession
    held = read_if_any(spark, path)
    todo = files if held is None else files.join(held.select("url"), "url", "left_anti")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[fetch(u) for u in pdf["url"]])

    todo.select("url", "file").mapInPandas(get, "url string, file string, content binary").filter("content is not null").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("url", "file")


def report(aggregate: DataFrame, breakdowns: DataFrame, details: DataFrame, path: str) -> None:
    """An evaluation report: three tables side by side."""
    for name, df in (("aggregate", aggregate), ("breakdowns", breakdowns), ("details", details)):
        write_json(df, f"{path}/{name}")


def clean(spark: SparkSession, root: str, everything: bool = False) -> list[str]:
    """Delete built tables below root through Spark's file systems; the two caches stay unless everything."""
    jvm = spark.sparkContext._jvm
    gone = []
    for name in ("documents", "chunks", "graph", "communities", "index", *(("extraction_cache", "summary_cache") if everything else ())):
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(name)
    return gone
