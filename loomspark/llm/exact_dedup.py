"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by (first bytes, SHA-256, identifier) of the normalised
text, the external sort places equal texts next to each other, and neighbouring full texts are
compared. The identifier is part of the order, so a text that a third of all rows share spans many
partitions; runs that touch a partition's edge are joined from one row per partition edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.sides import small
from loomspark.storage import bounded_batches, written

#: Characters of the text in the sort key: splitters stay small however long the texts are.
KEY_CHARS = 32


_NAMES = ["_id", "_sha", "_part", "_opens", "_closes", "_n", "_last", "_is_last"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order with their run of equal texts: its size and last row within this partition.

    Only identifiers and digests of the open run are held, and one text.
    """
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    opens, last_text = True, None
    for batch in batches:
        if not len(batch):
            continue
        text, slim = batch.column(2), batch.select([0, 1])
        new = np.flatnonzero(pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)) + 1
        cuts = np.concatenate([[0], new, [len(batch)]]).astype(np.int64)
        if held and text[0].as_py() != last_text:
            yield from _run(held, part, opens, False)
            held, opens = [], False
        last_text = text[len(text) - 1].as_py()
        if len(cuts) == 2:
            held.append(slim)
            continue
        begin = 0
        if held or opens:
            held.append(slim.slice(0, cuts[1]))
            yield from _run(held, part, opens, False)
            opens, begin = False, 1
        if len(sizes := np.diff(cuts[begin:-1])):
            rows = slim.slice(cuts[begin], int(sizes.sum()))
            ends = np.cumsum(sizes) - 1
            yield _rows(rows, part, False, False, np.repeat(sizes, sizes), rows.column(0).take(pa.array(np.repeat(ends, sizes))), ends)
        held = [slim.slice(cuts[-2])]
    if held:
        yield from _run(held, part, opens, True)


def _run(held: list[pa.RecordBatch], part: int, opens: bool, closes: bool) -> Iterator[pa.RecordBatch]:
    n = sum(map(len, held))
    last = held[-1].column(0)[len(held[-1]) - 1].as_py()
    for i, b in enumerate(held):
        yield _rows(b, part, opens, closes, np.full(len(b), n), pa.array([last] * len(b), b.column(0).type), [len(b) - 1] if i == len(held) - 1 else [])


def _rows(b: pa.RecordBatch, part: int, opens: bool, closes: bool, n: np.ndarray, last: pa.Array, ends: list[int]) -> pa.RecordBatch:
    is_last = np.zeros(len(b), bool)
    is_last[ends] = True
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(b), part, np.int32)), pa.array(np.full(len(b), opens)), pa.array(np.full(len(b), closes)), pa.array(n.astype(np.int64)), last, pa.array(is_last)], names=_NAMES)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Args: keep: whether the row with the smallest or the largest identifier of equal texts stays.
        normalise: applied to the text before it is compared; by default no change.
    Null text counts as empty. Rows that tie on identifier and text: one of them is kept. A null
    identifier is kept only if all of the group are null. No rows in, no rows out; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), "_text")
    order = F.col("_id").asc_nulls_first() if keep == "max" else F.col("_id").desc_nulls_first()
    key = F.substring("_text", 1, KEY_CHARS)
    dealt = rows.repartitionByRange(key, F.col("_sha"), order).sortWithinPartitions(key, F.col("_sha"), order)
    runs = written(dealt.mapInArrow(_runs, f"_id {kind}, _sha string, _part int, _opens boolean, _closes boolean, _n bigint, _last {kind}, _is_last boolean"), "exact-runs")
    fixed = _across(runs, kind)
    # One row for each partition edge at most: small by construction, so the planner may broadcast it.
    joined = runs.join(F.broadcast(fixed), [runs._part == fixed.part, runs._opens == fixed.opens, runs._closes == fixed.closes], "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("part").isNull(), F.col("_last")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("n", "_n").alias("group_size"),
        (F.col("_is_last") & F.coalesce(F.col("final"), F.lit(True))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _across(runs: DataFrame, kind: str) -> DataFrame:
    """Runs that go over partition edges: (part, opens, closes) with the whole run's size and last row.

    The driver sees two rows for each partition, never rows for each document.
    """
    edges = runs.filter("_opens or _closes").groupBy("_part", "_opens", "_closes").agg(F.first("_sha").alias("sha"), F.first("_n").alias("n"), F.first("_last").alias("last")).collect()
    edges = sorted(edges, key=lambda r: (r._part, not r._opens, r._closes))
    chains: list[list] = []
    for e in edges:
        if e._opens and chains and chains[-1][-1]._closes and chains[-1][-1].sha == e.sha:
            chains[-1].append(e)
        else:
            chains.append([e])
    out = [(e._part, e._opens, e._closes, sum(x.n for x in c), c[-1].last, e is c[-1]) for c in chains if len(c) > 1 for e in c]
    return runs.sparkSession.createDataFrame(out, f"part int, opens boolean, closes boolean, n bigint, last {kind}, final boolean")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay as they are.

    Of rows equal in identifier and text one stays, even if other columns differ.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    slim = written(groups.select(F.col(id_col).alias("__ls_id"), F.unhex("text_sha256").alias("__ls_kept_sha"), "kept"), "exact-kept")
    marked = docs.withColumn("__ls_sha", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    same = lambda side: [marked[id_col].eqNullSafe(side["__ls_id"]), marked["__ls_sha"] == side["__ls_kept_sha"]]
    if slim.groupBy("__ls_id", "__ls_kept_sha").count().filter("count > 1").isEmpty():
        # identifier and text tell all rows apart: the few that go are named, and documents need no shuffle while those are few
        gone = small(slim.filter("not kept").drop("kept"), 48)
        return marked.join(gone, same(gone), "left_anti").drop("__ls_sha")
    kept = small(slim.filter("kept").drop("kept"), 48)
    return marked.join(kept, same(kept), "left_semi").dropDuplicates([id_col, "__ls_sha"]).drop("__ls_sha")
