"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source's weight schedule is integrated; the share of its demand that falls before time t is
inverted, so every word the mix takes from a source gets a training time, and documents are
range-sorted by it. Within a source, documents stand in the order of a hash; their cumulative sizes
come from sums of hash buckets, so a source with a third of all rows is spread over all buckets.
The number of buckets grows with the rows, so that a bucket stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.sides import small
from loomspark.llm.textbytes import WORD
from loomspark.storage import written

WEIGHTS = (5, 2, 1)
#: Knots (time, relative weight) for each entry of WEIGHTS: heavy sources early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
REPEATS = 3
#: Rows that a bucket holds about, and the least number of hex digits of the hash that name a bucket.
BUCKET_ROWS, LEAST_DIGITS = 100_000, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target): one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at repeats times its
    source's size; what is left over goes to the others by weight. A source is full exactly if its
    size per weight lies under the final level, so sorting by that ratio finds the level at once.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("most", F.col("source_size") * float(repeats))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_fill), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_fill), F.lit(0.0)))
    leveled = named.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"]
    return leveled.withColumn("final", final).select("source", "rank", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("w"))).alias("target"))


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float, float]]:
    """(t0, length, m0, slope, share before, whole integral) of each linear piece."""
    area = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False)]
    whole, out, before = sum(area), [], 0.0
    for ((t0, m0), (t1, m1)), a in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        if a > 0:
            out.append((t0, t1 - t0, m0, (m1 - m0) / (t1 - t0), before / whole, whole))
        before += a
    return out


def training_time(share: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source has given this share (0..1) of all it gives: the inverted integral."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        time = None
        for t0, _, m0, slope, before, whole in _segments(knots):
            y = F.greatest((share - before) * whole, F.lit(0.0))
            here = F.lit(t0) + 2 * y / (F.lit(m0) + F.sqrt(F.greatest(F.lit(m0 * m0) + 2 * slope * y, F.lit(0.0))))
            here = here if m0 > 0 else F.when(y > 0, here).otherwise(F.lit(t0))
            time = here if time is None else F.when(share >= before, here).otherwise(time)
        out = F.when(rank % len(schedules) == i, time).otherwise(out)
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, schedules: tuple = SCHEDULES, seed: str = "", carry: Column | None = None) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, copies, first_time.

    Size is the number of words (null text: 0). A source gives round(target) words: whole passes over
    its documents in hash order, then a last pass that stops at the target, inside a document if need
    be. taken counts a document's words with repeats, at most repeats times its size; first_time is
    the training time of its first copy (null if none is taken). Null is a source of its own, the
    last. Rows equal in identifier share a hash and follow each other by size. No rows in, none out.
    carry: a column of docs to return as ``carried``.
    """
    carry = F.lit(0).cast("long") if carry is None else carry
    slim = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), carry.alias("carried")), "mix-sizes")
    targets = source_targets(slim, weights, repeats).withColumnRenamed("source", "of")
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, slim.count() / BUCKET_ROWS), 16)))
    hashed = slim.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))).withColumn("bucket", F.substring("h", 1, digits))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("before"))
    starts = starts.join(targets, starts.s.eqNullSafe(targets.of)).drop("of")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(starts, [placed.source.eqNullSafe(starts.s), placed.bucket == starts.b])
    start = F.col("before") + F.col("inside")
    demand = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(F.lit(0))
    rest = demand - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(rest - start, F.col("size")))
    placed = placed.select("id", "source", "carried", "rank", "h", "size", "source_size", "target", demand.alias("demand"), start.alias("start"), whole.alias("whole"), part.alias("part"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"),
        F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0)).alias("copies"),
        F.when(taken > 0, training_time(F.col("start") / F.col("demand"), F.col("rank"), schedules)).alias("first_time"),
        F.col("h").alias("order_hash"), "rank", "start", "demand", "carried",
    )


def in_training_order(assigned: DataFrame) -> DataFrame:
    """assigned, range-sorted by the training time of the first copy; documents that are not taken come first, by hash.

    The hash is part of the order, so that equal times (all documents without one) span many partitions.
    """
    return assigned.repartitionByRange("first_time", "order_hash").sortWithinPartitions("first_time", "order_hash")


def curriculum(assigned: DataFrame, id_col: str = "doc_id", schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per training occurrence, range-sorted: id_col, copy, words, train_time.

    words: how many of the document's words this copy gives; the last copy may be cut at the target.
    """
    copies = assigned.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = (F.col("copy") * F.col("source_size") + F.col("start")) / F.col("demand")
    words = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    out = copies.select(id_col, "copy", words.alias("words"), training_time(at, F.col("rank"), schedules).alias("train_time"), "order_hash")
    return out.repartitionByRange("train_time", "order_hash").sortWithinPartitions("train_time", "order_hash").drop("order_hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The documents that the mix takes, range-sorted by the training time of their first copy.

    All columns of docs, and taken, copies, first_time (columns of these names are replaced). Rows equal
    in identifier and text share the values of the first of them.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    given = assign(docs, id_col, text_col, source_col, carry=text_hash, **options).filter("taken > 0")
    given = given.groupBy(F.col(id_col).alias("__ls_id"), F.col("carried").alias("__ls_text")).agg(F.min(F.struct("first_time", "order_hash", "taken", "copies")).alias("__ls_mix"))
    new = ("taken", "copies", "first_time")
    given = small(written(given, "mix-given"), 80)
    marked = docs.drop(*new).withColumn("__ls_own", text_hash)
    out = marked.join(given, [marked[id_col].eqNullSafe(F.col("__ls_id")), F.col("__ls_own") == F.col("__ls_text")])
    out = out.repartitionByRange(F.col("__ls_mix.first_time"), F.col("__ls_mix.order_hash")).sortWithinPartitions("__ls_mix.first_time", "__ls_mix.order_hash")
    for name in new:
        out = out.withColumn(name, F.col(f"__ls_mix.{name}"))
    return out.drop("__ls_id", "__ls_text", "__ls_own", "__ls_mix")
