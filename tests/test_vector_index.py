import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import vector_index as vi
from loomspark.operators.retrieval import nearest


@pytest.fixture(scope="module")
def clustered(spark):
    """900 vectors in 12 clusters, a third of them equal, some rows that cannot be indexed."""
    r = random.Random(2)
    centers = [[r.gauss(0, 10) for _ in range(6)] for _ in range(12)]
    rows = [(i, centers[3] if i % 3 == 0 else [x + r.gauss(0, 1) for x in centers[i % 12]], "x") for i in range(900)]
    rows += [(900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (902, [math.nan] * 6, "x"), (903, [math.inf] * 6, "x"), (None, centers[0], "x"), (904, [], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string").cache()


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_probed_lists_hold_the_neighbours(spark, clustered, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(vi, "PART_ROWS", part_rows)
    monkeypatch.setattr(vi, "QUERY_ROWS", 30)
    vi.build_vector_index(clustered, str(tmp_path / "ix"))
    index = vi.open_vector_index(spark, str(tmp_path / "ix"))
    assert index.read(spark).count() == 900 and 1 < index.probe < len(index.parts)
    assert part_rows > 40 or max(index.parts.values()) > 5
    q = clustered.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    truth = nearest(clustered.filter("vec_id < 900"), q.filter("query_id < 900"), 8).withColumnRenamed("vec_id", "id")
    row = vi.recall(vi.search_index(index, q, 8), truth).first()
    assert row.queries == 18 and row.recall >= 0.9
    every = vi.search_index(index, q, 8, probe=len(index.parts), candidates=900)
    assert {(r.query_id, r.id, round(r.distance, 9), r["rank"]) for r in every.collect()} == {(r.query_id, r.id, round(r.distance, 9), r["rank"]) for r in truth.collect()}


@pytest.mark.parametrize("held", [vi.HELD, 50])
def test_a_query_brings_candidates_of_groups_not_of_lists(spark, clustered, tmp_path, monkeypatch, held):
    monkeypatch.setattr(vi, "PART_ROWS", 300)
    index = vi.build_vector_index(clustered, str(tmp_path / "ix"))
    q = clustered.filter("vec_id % 50 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    asked = vi.probes(index, q, len(index.parts))
    monkeypatch.setattr(vi, "HELD", held)
    rough = vi.shortlists(index, index.read(spark), asked, q, 4).collect()
    assert asked.count() >= 18 * 20 and 18 * 4 <= len(rough) <= 18 * 4 * 3
    equal = [r.id for r in vi.search_index(index, q.filter("query_id = 0"), 4, len(index.parts), 1).orderBy("rank").collect()]
    assert equal == [0, 3, 6, 9]  # of 300 equal vectors


def test_only_probed_lists_are_read(spark, clustered, tmp_path):
    index = vi.build_vector_index(clustered, str(tmp_path / "ix"))
    found = vi.search_index(index, clustered.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 8, probe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(list#\d+ IN \(\d+,\d+\))", plan)
    assert len(scans) >= 2 and found.first().distance == 0.0


def test_empty_tables(spark, clustered, tmp_path):
    none = clustered.limit(0)
    index = vi.build_vector_index(none, str(tmp_path / "ix"))
    q = clustered.limit(3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert vi.search_index(index, q).count() == 0
    some = vi.build_vector_index(clustered, str(tmp_path / "iy"), lists=4)
    assert vi.search_index(some, q.limit(0)).count() == 0
