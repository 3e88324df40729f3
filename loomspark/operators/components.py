"""Connected components by contraction.

Each round every node joins its smallest neighbour (or itself), edges are rewritten to the joined
nodes and duplicates and loops go. Rounds alternate between the order of the nodes and a fresh hash
order, so that stars to a small node collapse at once and ordered paths shrink geometrically.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.storage import fresh_path, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node of its component.

    Edges with a null endpoint are ignored; a loop makes a component of one node.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    left = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps = []
    left = left.filter("a <> b")
    for r in range(max_rounds):
        if left.isEmpty():
            break
        rank = (lambda c: F.struct(c.alias("k"))) if r % 3 != 2 else (lambda c, r=r: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("k")))
        both = left.select("a", "b").union(left.select("b", "a"))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        joined = written(low.select(F.col("a").alias("u"), F.least("m", rank(F.col("a")))["k"].alias("p")), "components-map")
        maps.append(joined)
        ends = left.join(joined.withColumnsRenamed({"u": "a", "p": "pa"}), "a").join(joined.withColumnsRenamed({"u": "b", "p": "pb"}), "b")
        left = written(ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "components-edges")
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    out = nodes.withColumn("root", F.col("node"))
    for m in maps:
        out = out.join(m, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
    out = written(out, "components-roots")
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")


@dataclass(frozen=True)
class GrowingComponents:
    """Components of a graph to which edges are added: members(node, root) at path, written once for each node when it is first
    seen, and moves(root, component) of the roots that have joined another one since."""

    path: str
    moves: DataFrame | None = None

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def components(self, spark: SparkSession) -> DataFrame:
        """(node, component), the component being its smallest node."""
        m = self.members(spark)
        if self.moves is None:
            return m.withColumnRenamed("root", "component")
        return m.join(self.moves, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def grown(edges: DataFrame, src: str = "src", dst: str = "dst", before: GrowingComponents | None = None) -> GrowingComponents:
    """The components with these edges too. Edges are contracted to the components of their ends, so that a batch costs what it and the
    components it touches cost: nodes that are new are appended, and only the moves of roots are written again.

    Edges with a null end are ignored; edges that are known change nothing. A batch that fails can be given again.
    """
    spark = edges.sparkSession
    pairs = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null").distinct(), "grown-edges")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if before is None:
        path = fresh_path(spark, "grown-members")
        components(pairs, "a", "b").withColumnRenamed("component", "root").write.parquet(path)
        return GrowingComponents(path)
    # of the nodes known so far only those of the batch are looked up
    known = written(before.components(spark).join(ends, "node", "left_semi"), "grown-known")
    of = lambda x, e: x.join(known.withColumnsRenamed({"node": e, "component": f"{e}_c"}), e, "left").withColumn(e, F.coalesce(f"{e}_c", e)).drop(f"{e}_c")
    joined = written(components(of(of(pairs, "a"), "b"), "a", "b").withColumnRenamed("node", "root"), "grown-joined")
    moved = joined.filter("root <> component")
    if before.moves is not None:
        old = before.moves.join(joined.select(F.col("root").alias("component"), F.col("component").alias("to")), "component", "left").select("root", F.coalesce("to", "component").alias("component"))
        moved = old.unionByName(moved.join(before.moves.select("root"), "root", "left_anti"))
    moves = written(moved, "grown-moves")
    new = written(ends.join(known.select("node"), "node", "left_anti"), "grown-nodes")
    # a new node is its own root: where the batch joined it to another, moves says so
    new.select("node", F.col("node").alias("root")).write.mode("append").parquet(before.path)
    return GrowingComponents(before.path, moves)
