"""Matching of query terms to nodes, nearest neighbours, chunks and snippets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import normalize_name
from loomspark.storage import written

#: Rows of a block of vectors or queries in a search for many.
BLOCK = 4096
#: Nodes of a word from which on it is frequent.
FREQUENT = 256


def _tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "")


def node_tokens(nodes: DataFrame) -> DataFrame:
    """(token, node_id, n_words, ord): the inverted index of node names."""
    return nodes.select("node_id", "ord", F.size(_tokens(F.col("node_id"))).alias("n_words"), F.explode(_tokens(F.col("node_id"))).alias("token"))


def match_terms(terms: DataFrame, nodes: DataFrame, top: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """terms(term_pos, term) -> term_pos, term, node_id, overlap, score, rank.

    A term that is a node matches it alone; otherwise nodes that share words of more than two letters, by
    (shared words, share of the node's words, order), the top of them. A word that more than ``frequent`` nodes have
    does not bring all of them to every term: see _frequent_hits().
    """
    named = terms.withColumn("key", normalize_name(F.col("term")))
    exact = named.join(nodes.select("node_id", "ord"), F.col("key") == F.col("node_id")).select("term_pos", "term", "node_id", F.size(_tokens(F.col("key"))).alias("overlap"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    rest = named.join(exact.select("term_pos"), "term_pos", "left_anti")
    words = rest.select("term_pos", "term", F.explode(F.filter(_tokens(F.col("key")), lambda w: F.length(w) > 2)).alias("token"))
    postings = node_tokens(nodes)
    counts = postings.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    often = written(counts.filter(F.col("count") > frequent).select("token"), "frequent-words")
    key = ["term_pos", "term", "node_id", "n_words", "ord"]
    if often.isEmpty():
        hits = words.join(postings, "token").groupBy(*key).agg(F.count("*").cast("int").alias("overlap"))
    else:
        hits = _frequent_hits(words, postings, often, key, top)
    scored = hits.withColumn("score", F.col("overlap") / F.greatest("n_words", F.lit(1)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("term_pos").orderBy(F.desc("overlap"), F.desc("score"), "ord")))
    return exact.unionByName(ranked.filter(F.col("rank") <= top).select(exact.columns))


def _frequent_hits(words: DataFrame, postings: DataFrame, often: DataFrame, key: list[str], top: int) -> DataFrame:
    """The nodes that may be among a term's top, with the number of shared words, without the long lists of frequent words.

    Nodes are put into kinds by the frequent words they have. Of those that share no rare word with a term, all of
    one kind share equally many words with it, so that the first of each kind, by words and order, hold every one that can
    be among the top. A kind's first are found once, whatever the number of terms. So are the kinds of terms that ask for the
    same frequent words: only the kinds whose first node is among the top can hold another of these. Nodes that share
    a rare word come from its short list, and count the frequent words of their kind.
    """
    kind = postings.join(often, "token", "left_semi").groupBy("node_id", "n_words", "ord").agg(F.array_sort(F.collect_set("token")).alias("kind"))
    kind = written(kind, "node-kinds")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("n_words", "ord"))
    first = kind.withColumn("place", place).filter(F.col("place") <= top).select("kind", "place", "node_id", "n_words", "ord")
    first = written(first, "kind-first")
    common = written(words.join(often, "token", "left_semi").groupBy("term_pos", "term").agg(F.array_sort(F.collect_set("token")).alias("common")), "frequent-asked")
    asked = common.select("common").distinct().select("common", F.explode("common").alias("token"))
    heads = first.filter("place = 1").drop("place", "node_id").withColumn("token", F.explode("kind"))
    best = lambda by: F.row_number().over(Window.partitionBy("common").orderBy(F.desc("overlap"), "n_words", "ord")) <= by
    kinds = asked.join(heads, "token").groupBy("common", "kind", "n_words", "ord").agg(F.count("*").cast("int").alias("overlap"))
    kinds = kinds.withColumn("in", best(top)).filter("in").select("common", "kind", "overlap")
    tops = kinds.join(first, "kind").withColumn("in", best(top)).filter("in").select("common", "overlap", "node_id", "n_words", "ord")
    rare = words.join(often, "token", "left_anti").join(postings, "token").groupBy(*key).agg(F.count("*").cast("int").alias("rare"))
    both = rare.join(common.select("term_pos", "common"), "term_pos", "left").join(kind.select("node_id", "kind"), "node_id", "left")
    shared = F.coalesce(F.size(F.array_intersect("kind", "common")), F.lit(0))
    full = both.select(*key, (F.col("rare") + F.greatest(shared, F.lit(0))).alias("overlap"))
    return common.join(tops, "common").select(*key, "overlap").unionByName(full).groupBy(*key).agg(F.max("overlap").alias("overlap"))


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: list[float] | DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors to one query by squared distance, ties by id: a scan and a distributed top-k.

    A table of queries(query_id, query), with unique ids, gives (query_id, id_col, distance, rank) for each of them.
    """
    if isinstance(query, DataFrame):
        return _nearest_each(vectors, query, k, id_col, vec_col)
    return vectors.withColumn("distance", squared_distance(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query]))).orderBy("distance", id_col).limit(k)


def _nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """Every block of vectors meets every block of queries in a task of its own, which keeps the k nearest of each query.

    Rows without an id or a vector, on either side, take no part.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    q = queries.select("query_id", F.col("query").cast("array<double>").alias("v")).filter("query_id is not null and v is not null")
    v_blocks, q_blocks = (max(1, -(-x.count() // BLOCK)) for x in (v, q))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = v.withColumn("vb", block("id", v_blocks)).withColumn("qb", every(q_blocks))
    right = q.withColumn("qb", block("query_id", q_blocks)).withColumn("vb", every(v_blocks))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((q, "query_id"), (v, "id"))]

    def search(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "distance": []}
        if len(vs) and len(qs):
            vs = vs.sort_values("id", ignore_index=True)
            x = np.stack(vs["v"].to_list())
            for name, y in zip(qs["query_id"], qs["v"], strict=True):
                d = ((x - y) ** 2).sum(1)
                kth = np.partition(d, k - 1)[k - 1] if k < len(d) else np.inf
                near = np.flatnonzero(d <= kth)
                near = near[np.argsort(d[near], kind="stable")][:k]
                out["query_id"] += [name] * len(near)
                out["id"] += vs["id"].iloc[near].to_list()
                out["distance"] += d[near].tolist()
        return pd.DataFrame(out)

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", "rank")


def source_chunks(matched: DataFrame, others: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(chunk_id, pos): chunks of matched nodes in match order, then of the others, the first few."""
    ranked = matched.select("node_id", F.lit(0).alias("g"), F.col("match_rank").cast("long").alias("r")).unionByName(others.join(matched.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(1).alias("g"), F.lit(0).cast("long").alias("r")))
    chunks = ranked.join(nodes.select("node_id", "source_chunk", "ord"), "node_id").filter("source_chunk <> ''").groupBy(F.col("source_chunk").alias("chunk_id")).agg(F.min(F.struct("g", "r", "ord")).alias("o"))
    return chunks.orderBy("o").limit(limit).select("chunk_id", F.row_number().over(Window.orderBy("o")).alias("pos"))
