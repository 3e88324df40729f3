"""Keys that were seen, kept as an append-only table in buckets with a Bloom filter for each batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.storage import fresh_path, written

#: Bits of one block of a filter (what the bitmap functions hold), bits and probes of a key: about 1 % false positives.
BLOCK_BITS, KEY_BITS, PROBES = 32768, 10, 7


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _positions(key: Column) -> Column:
    """The bits of a key in its block, by two hashes."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS).cast("long")) for i in (1, 2))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(a + i * b, F.lit(BLOCK_BITS).cast("long")))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class Visited:
    """The keys of all batches that add() was given.

    Each batch is appended to a bucketed table; nothing is written again. unseen() looks keys up in the filters, a byte or
    so for each key seen, and compares only those that a filter holds with the table itself, whose side of
    the join is read in its buckets, not shuffled. Keys are strings; nulls are never seen and never added. close() drops
    the table.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"visited_{uuid.uuid4().hex}"
        self.path = fresh_path(spark, "visited")
        self.filters: list[tuple[DataFrame, int]] = []

    def add(self, keys: DataFrame) -> int:
        """Append keys(key), distinct and not added before; how many."""
        keys = keys.select("key").filter("key is not null")
        count = keys.count()
        if count:
            blocks = -(-count * KEY_BITS // BLOCK_BITS)
            placed = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(_positions(F.col("key"))).alias("position"))
            bits = placed.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))
            self.filters.append((written(bits, "visited-filter"), blocks))
            apart = keys.repartition(self.buckets, "key")  # one file a bucket
            apart.write.bucketBy(self.buckets, "key").mode("append").option("path", self.path).format("parquet").saveAsTable(self.name)
        return count

    def maybe(self, keys: DataFrame) -> DataFrame:
        """keys(key) with ``maybe``: false only for those that no batch held."""
        out = keys.select("key", F.lit(False).alias("maybe"))
        for bits, blocks in self.filters:
            held = out.withColumn("block", _block(F.col("key"), blocks)).join(bits, "block", "left")
            hit = F.forall(_positions(F.col("key")), lambda p: _bit(F.col("bits"), p))
            out = held.select("key", (F.col("maybe") | (F.col("bits").isNotNull() & F.coalesce(hit, F.lit(False)))).alias("maybe"))
        return out

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The distinct keys(key) that were not added."""
        keys = keys.select("key").filter("key is not null").distinct()
        if not self.filters:
            return keys
        asked = written(self.maybe(keys), "visited-asked")
        again = asked.filter("maybe").select("key")
        return asked.filter("not maybe").select("key").unionByName(again.join(self.spark.table(self.name), "key", "left_anti"))

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
