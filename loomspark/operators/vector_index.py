"""An inverted-list vector index: k-means lists, 8-bit codes, probing, exact re-ranking.

Centroids are fitted by Lloyd rounds over a bounded sample; every vector is then written to the list of
its nearest centroid, with a code of one byte a component for its difference to the centroid. Lists
are partition folders, so that a search reads those it probes and no others; a list of many rows has
several parts, each met by a task of its own. How many lists a search probes is measured when the index
is built: enough to hold RECALL of the true neighbours of a bounded sample of vectors. A search ranks
the codes of the probed lists and reads the exact vectors of the best ones, whose squared distances decide.

Rows without an id or a vector, or with a component that is null or not finite, are not indexed.
Vectors have one length. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.retrieval import nearest
from loomspark.storage import written

#: Rows of the sample for each list, rounds of k-means, rows of a part of a list and of the lists that one task of a search ranks, queries of a task.
SAMPLE_PER_LIST, ROUNDS, PART_ROWS, QUERY_ROWS = 256, 8, 50_000, 4096
#: Share of the true neighbours that the probed lists of a sample of vectors hold, its size; candidates that are ranked exactly, for each result asked for.
RECALL, MEASURED, CANDIDATES = 0.95, 200, 8
#: Distances that a task holds at once, candidates that it gathers before it keeps the best of each query.
HELD = 4_000_000
#: Most lists: centroids travel to every task, and lists are folders.
MOST_LISTS = 16_384


@dataclass(frozen=True)
class VectorIndex:
    """lists(list, part, id, code, scale, vector) at path, and the centroids, one row for each list."""

    path: str
    centroids: np.ndarray
    parts: dict[int, int]
    probe: int = 1

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centroids of each row, nearest first."""
    d = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    if n == 1:
        return d.argmin(1)[:, None]
    near = np.argpartition(d, n - 1, 1)[:, :n] if n < len(centroids) else np.broadcast_to(np.arange(len(centroids)), d.shape).copy()
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector) of the rows that can be indexed."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & whole & (F.size("vector") > 0))


def fit_centroids(vectors: DataFrame, lists: int, rounds: int = ROUNDS, sample: int | None = None) -> np.ndarray:
    """Centroids of (id, vector) by k-means over at most ``sample`` rows, drawn by hash of the id; each round is one aggregation."""
    sample = sample or SAMPLE_PER_LIST * lists
    rows = vectors.count()
    drawn = vectors if rows <= sample else vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * sample / rows)))
    drawn = written(drawn, "kmeans-sample")
    first = drawn.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(lists).collect()
    centroids = np.array([r.vector for r in first])
    if not len(centroids):
        return np.empty((0, 0))
    d = centroids.shape[1]

    def sums(current: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(current), np.zeros(len(current), np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("vector"))
                    near = _nearest_lists(x, current, 1)[:, 0]
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(current))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"list": pa.array(some, pa.int32()), "n": pa.array(n[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.float64()))})

        return run

    for _ in range(rounds):
        parts = drawn.select("vector").mapInArrow(sums(centroids), "list int, n long, total array<double>")
        means = parts.groupBy("list").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total")).collect()
        moved = centroids.copy()
        for r in means:  # one row a list; a list that no row is near to stays where it is
            moved[r.list] = np.array(r.total) / r.n
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def build_vector_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, rounds: int = ROUNDS, k: int = 8) -> VectorIndex:
    """Index every usable row of vectors at path; lists: about the square root of the number of rows unless given; k: results that searches will ask for."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    centroids = fit_centroids(rows, max(1, min(lists or round(n**0.5), MOST_LISTS)), rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                near = _nearest_lists(x, centroids, 1)[:, 0]
                rest = x - centroids[near]
                scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), b.column("vector")], names=["list", "id", "code", "scale", "vector"])

    kind = rows.schema["id"].dataType.simpleString()
    coded = written(rows.mapInArrow(code, f"list int, id {kind}, code binary, scale double, vector array<double>"), "codes")
    counts = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    parts = {c: -(-m // PART_ROWS) for c, m in counts.items()}
    known = F.broadcast(spark.createDataFrame(list(parts.items()), "list int, parts int"))
    dealt = coded.join(known, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").partitionBy("list", "part").parquet(f"{path}/lists")
    probe = measured_probe(coded, centroids, parts, k)
    made = [(i, parts.get(i, 0), probe, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(made, "list int, parts int, probe int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return VectorIndex(path, centroids, parts, probe)


def measured_probe(coded: DataFrame, centroids: np.ndarray, parts: dict[int, int], k: int) -> int:
    """The least number of nearest lists that hold RECALL of the k true neighbours of at most MEASURED rows of coded(list, id, vector)."""
    sample = coded.select(F.col("id").alias("query_id"), F.col("vector").alias("query")).orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    truth = nearest(coded, written(sample, "measured"), k + 1, "id", "vector").filter("query_id <> id")
    rows = truth.join(sample, "query_id").join(coded.select("id", "list"), "id").select("query", "list").collect()
    if not rows:
        return 1
    filled = np.array(sorted(parts))
    order = filled[_nearest_lists(np.array([r.query for r in rows]), centroids[filled], len(filled))]
    rank = (order == np.array([r["list"] for r in rows])[:, None]).argmax(1)
    return int(np.quantile(rank, RECALL, method="higher")) + 1


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    made = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, np.array([r.centroid for r in made]), {r["list"]: r.parts for r in made if r.parts}, max((r.probe for r in made), default=1))


def probes(index: VectorIndex, queries: DataFrame, probe: int) -> DataFrame:
    """queries(query_id, query) -> (query_id, list, part) for every part of the nearest lists that have rows."""
    filled = np.array(sorted(index.parts))
    centroids = index.centroids[filled]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = filled[_nearest_lists(_matrix(b.column("query")), centroids, min(probe, len(filled)))]
                yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "lists"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = queries.mapInArrow(near, f"query_id {kind}, lists array<int>").select("query_id", F.explode("lists").alias("list"))
    known = F.broadcast(queries.sparkSession.createDataFrame(list(index.parts.items()), "list int, parts int"))
    return found.join(known, "list").select("query_id", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def exact_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def _best(asking: np.ndarray, row: np.ndarray, rough: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first ``most`` of their query (asking), by rough distance, ties by place of the row's id."""
    order = np.lexsort((place[row], rough, asking))
    first = np.r_[True, np.diff(asking[order]) != 0] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < most]


def _ranked(centroids: np.ndarray, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The work of a task: of the codes of several lists the best for each query, which looks into some of these lists."""

    def rank(codes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0))]
        if not len(codes) or not len(asking):
            return pd.DataFrame({"query_id": [], "list": [], "part": [], "id": [], "rough": []})
        codes = codes.sort_values(["place", "id"], ignore_index=True)
        place = np.empty(len(codes), np.int64)
        place[np.argsort(codes["id"].to_numpy(), kind="stable")] = np.arange(len(codes))
        places, starts = np.unique(codes["place"].to_numpy(), return_index=True)
        ends = np.r_[starts[1:], len(codes)]
        q = np.stack(asking["query"].to_list())
        own = (q**2).sum(1)
        who, where = np.repeat(np.arange(len(asking)), asking["places"].map(len)), np.concatenate(asking["places"].to_list())
        who = who[np.argsort(where, kind="stable")]
        where = np.sort(where, kind="stable")
        gathered = 0
        for at, lo, hi in zip(places, starts, ends, strict=True):
            askers = who[np.searchsorted(where, at) : np.searchsorted(where, at, "right")]
            if not len(askers):
                continue
            some = codes.iloc[lo:hi]
            x = np.frombuffer(b"".join(some["code"]), np.int8).reshape(hi - lo, -1) * some["scale"].to_numpy()[:, None] + centroids[int(some["list"].iloc[0])]
            norm, step = (x**2).sum(1), max(1, HELD // (hi - lo))
            for i in range(0, len(askers), step):
                these = askers[i : i + step]
                d = norm[None, :] - 2 * q[these] @ x.T + own[these][:, None]
                if most < hi - lo:
                    r, c = np.nonzero(d <= np.partition(d, most - 1, 1)[:, most - 1 : most])
                else:
                    r, c = (m.ravel() for m in np.indices(d.shape))
                found = these[r], lo + c, d[r, c]
                if len(r) > most * len(these):  # equal distances
                    kept = _best(*found, place, most)
                    found = tuple(f[kept] for f in found)
                pool.append(found)
                gathered += len(found[0])
                if gathered > HELD:
                    every = tuple(np.concatenate(f) for f in zip(*pool, strict=True))
                    kept = _best(*every, place, most)
                    pool, gathered = [tuple(f[kept] for f in every)], 0
        asked, row, rough = (np.concatenate(f) for f in zip(*pool, strict=True))
        kept = _best(asked, row, rough, place, most)
        out = codes[["list", "part", "id"]].iloc[row[kept]].reset_index(drop=True)
        return out.assign(query_id=asking["query_id"].to_numpy()[asked[kept]], rough=rough[kept])[["query_id", "list", "part", "id", "rough"]]

    return rank


def shortlists(index: VectorIndex, stored: DataFrame, asked: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, list, part, id, rough): of the lists asked(query_id, list, part) the ``most`` nearest codes of each group of lists.

    A group has about PART_ROWS rows, and is one task's for each block of queries: what a query brings grows with the groups, not the lists.
    """
    groups, blocks = (max(1, -(-x.count() // n)) for x, n in ((stored, PART_ROWS), (queries, QUERY_ROWS)))
    group = F.pmod(F.xxhash64("list", "part"), F.lit(groups)).cast("int").alias("group")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    place = F.shiftleft(F.col("list").cast("long"), 32) + F.col("part")
    left = stored.select("list", "part", "id", "code", "scale", group, place.alias("place"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.groupBy("query_id", group).agg(F.collect_list(place).alias("places")).join(queries, "query_id").select("*", block)
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (stored, "id"))]
    keys = ["group", "block"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_ranked(index.centroids, most), f"query_id {kinds[0]}, list int, part int, id {kinds[1]}, rough double")


def search_index(index: VectorIndex, queries: DataFrame, k: int = 8, probe: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """queries(query_id, query), unique ids -> (query_id, id, distance, rank) of the k nearest found; probe: lists a query looks into."""
    spark = queries.sparkSession
    usable_queries = usable(queries, "query_id", "query").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    stored = index.read(spark) if index.parts else None
    if stored is None:
        return usable_queries.select("query_id", F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    asked = written(probes(index, usable_queries, probe or index.probe), "probes")
    lists = [r["list"] for r in asked.select("list").distinct().collect()]  # at most one row a list
    wanted = stored if len(lists) == len(index.parts) else stored.filter(F.col("list").isin(lists))
    most = k * candidates
    rough = shortlists(index, wanted, asked, usable_queries, most)
    by = Window.partitionBy("query_id")
    short = rough.withColumn("r", F.row_number().over(by.orderBy("rough", "id"))).filter(F.col("r") <= most).select("query_id", "list", "part", "id")
    exact = wanted.select("list", "part", "id", "vector").join(short, ["list", "part", "id"]).join(usable_queries, "query_id").withColumn("distance", exact_distance(F.col("vector"), F.col("query")))
    return exact.withColumn("rank", F.row_number().over(by.orderBy("distance", "id"))).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of truth(query_id, id) that is in found(query_id, id)."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share")).agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))
