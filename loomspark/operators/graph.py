"""The property graph as tables: nodes, directed edges; everything else is derived."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import entity_line, normalize_name, relation_line
from loomspark.operators.components import components
from loomspark.operators.merge import folded, told_once
from loomspark.storage import written


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, name, type, description, source_chunk, ord); edges(src, dst, relation_type, description, weight, source_chunk, ord); entity_map like nodes."""

    nodes: DataFrame
    edges: DataFrame
    entity_map: DataFrame


def build_nodes(entities: DataFrame) -> DataFrame:
    """One node per normalised name, whatever the type: the last entity's attributes, the first one's order."""
    last = F.max_by(F.struct("name", "type", "description", "source_chunk"), "ord")
    return entities.groupBy(normalize_name(F.col("name")).alias("node_id")).agg(last.alias("x"), F.min("ord").alias("ord")).select("node_id", "x.*", "ord")


def build_entity_map(entities: DataFrame) -> DataFrame:
    """The first entity of each node with the descriptions of all folded."""
    first = F.min_by(F.struct("name", "type", "source_chunk"), "ord")
    keyed = told_once(entities.withColumn("node_id", normalize_name(F.col("name"))), ["node_id"], "ord", ["name", "type", "source_chunk"])
    return keyed.groupBy("node_id").agg(first.alias("x"), folded(F.col("description"), F.col("ord")).alias("description"), F.min("ord").alias("ord")).select("node_id", "x.*", "description", "ord")


def build_edges(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """One directed edge per ordered pair of existing nodes: summed weight, the first relation's other attributes."""
    r = relationships.select(normalize_name(F.col("source")).alias("src"), normalize_name(F.col("target")).alias("dst"), "relation_type", "description", "weight", "source_chunk", "ord")
    ids = nodes.select("node_id")
    r = r.join(ids, r.src == ids.node_id, "left_semi").join(ids, r.dst == ids.node_id, "left_semi")
    first = F.min(F.struct("ord", "relation_type", "description", "source_chunk"))
    # texts among the results make Spark sort by the keys: the hash decides nearly every comparison
    return r.groupBy(F.xxhash64("src", "dst").alias("h"), "src", "dst").agg(first.alias("x"), F.sum("weight").alias("weight")).select("src", "dst", "x.relation_type", "x.description", "x.source_chunk", "weight", "x.ord")


def rejected_relationships(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships with an end that is no node."""
    r = relationships.withColumn("src", normalize_name(F.col("source"))).withColumn("dst", normalize_name(F.col("target")))
    ids = nodes.select("node_id", F.lit(True).alias("known"))
    r = r.join(ids.withColumnsRenamed({"node_id": "src", "known": "a"}), "src", "left").join(ids.withColumnsRenamed({"node_id": "dst", "known": "b"}), "dst", "left")
    return r.filter("a is null or b is null").drop("a", "b")


def build_graph(entities: DataFrame, relationships: DataFrame) -> Graph:
    nodes = build_nodes(entities)
    return Graph(nodes, build_edges(relationships, nodes), build_entity_map(entities))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a <= b; both directions summed."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour) in both directions, once each."""
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()


def degrees(graph: Graph) -> DataFrame:
    """(node_id, degree) over undirected edges; a loop counts twice, a lone node 0."""
    ends = undirected(graph.edges).select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return graph.nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node_id, hop): nodes at distance 1..hops of each seed (column node_id), the seed left out.

    The frontier is the small side; a visited pair is never expanded again. Seeds that have reached the same nodes
    in a hop, as those around one hub do, are expanded once: see _expanded().
    """
    near = written(adjacency(edges), "adjacency")
    seen = written(seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("hop")).distinct(), "hop-0")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(near, "node_id").select("seed", F.col("neighbour").alias("node_id")).distinct() if hop == 1 else _expanded(frontier, near)
        # written, since each hop reads all before it: a lineage would double with every hop
        frontier = written(reached.join(seen, ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        seen = seen.unionByName(frontier)
        if hop < hops and frontier.isEmpty():
            break
    return seen.filter("hop > 0")


def _expanded(frontier: DataFrame, near: DataFrame) -> DataFrame:
    """(seed, node_id): what is next to the frontier(seed, node_id) of each seed.

    Equal frontiers, known by their size and two hashes of 64 bits, are expanded for the first of their seeds. The paths
    between seeds of one frontier and its neighbours are so never made, only the pairs that result.
    """
    spark = frontier.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node_id")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node_id")).alias("i")]
    marks = written(frontier.groupBy("seed").agg(*mark), "frontier-marks")
    heads = marks.groupBy("n", "h", "i").agg(F.min("seed").alias("head"))
    same = written(marks.join(heads, ["n", "h", "i"]).select("seed", "head"), "frontier-heads")
    one = frontier.join(same.select(F.col("head").alias("seed")).distinct(), "seed", "left_semi")
    found = written(one.join(near, "node_id").select(F.col("seed").alias("head"), F.col("neighbour").alias("node_id")).distinct(), "frontier-expanded")
    # a head of many seeds is many tasks', by node
    part = F.pmod(F.xxhash64("node_id"), F.lit(tasks)).cast("int")
    every = same.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return found.withColumn("part", part).join(every, ["head", "part"]).select("seed", "node_id")


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph on the nodes of keep (column node_id)."""
    ids = keep.select("node_id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return Graph(graph.nodes.join(ids, "node_id", "left_semi"), edges, graph.entity_map.join(ids, "node_id", "left_semi"))


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """Outgoing and incoming edges of a node; a loop is listed twice."""
    out = edges.filter(F.col("src") == node_id).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(edges.filter(F.col("dst") == node_id).withColumn("direction", F.lit("incoming")))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("relation_type", F.lit("Unknown")).alias("relation_type")).agg(F.count("*").alias("n"))


def node(graph: Graph, name: str) -> DataFrame:
    """The node of a name in any spelling, or no row."""
    return graph.nodes.filter(F.col("node_id") == normalize_name(F.lit(name)))


def entity(graph: Graph, name: str) -> DataFrame:
    """The entity of a name in any spelling, or no row."""
    return graph.entity_map.filter(F.col("node_id") == normalize_name(F.lit(name)))


def statistics(graph: Graph) -> DataFrame:
    """One row: num_nodes, num_edges (undirected), num_components, avg_degree, density."""
    pairs = undirected(graph.edges)
    joined = components(pairs, "a", "b").agg(F.count("*").alias("joined"), F.countDistinct("component").alias("parts"))
    counts = graph.nodes.agg(F.count("*").alias("num_nodes")).join(pairs.agg(F.count("*").alias("num_edges")), how="cross").join(joined, how="cross")  # one row each
    n, m = F.col("num_nodes"), F.col("num_edges")
    return counts.select("num_nodes", "num_edges", (n - F.col("joined") + F.col("parts")).alias("num_components"), (2 * m / F.greatest(n, F.lit(1))).alias("avg_degree"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"))


def list_entities(graph: Graph, limit: int = 100, kind: str | None = None) -> DataFrame:
    """The first entities of a type in order of appearance, then sorted by degree: the limit comes before the sort."""
    nodes = graph.nodes if kind is None else graph.nodes.filter(F.lower("type") == kind.lower())
    first = nodes.orderBy("ord").limit(limit)
    return first.join(degrees(graph), "node_id").orderBy(F.desc("degree"), "ord")


def context(graph: Graph, max_nodes: int = 20, max_edges: int = 30) -> DataFrame:
    """One row with the text of the top nodes by degree and the top edges by weight."""
    top = graph.nodes.join(degrees(graph), "node_id").orderBy(F.desc("degree"), "ord").limit(max_nodes)
    named = graph.nodes.select("node_id", "name")
    edges = graph.edges.orderBy(F.desc("weight"), "ord").limit(max_edges)
    edges = edges.join(named.withColumnsRenamed({"node_id": "src", "name": "s"}), "src").join(named.withColumnsRenamed({"node_id": "dst", "name": "t"}), "dst")
    a = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "ord", entity_line(F.coalesce("name", "node_id"), F.col("type"), F.col("description")).alias("line")))).alias("x"))
    b = edges.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("d"), "ord", relation_line(F.col("s"), F.col("relation_type"), F.col("t"), F.col("description")).alias("line")))).alias("y"))
    text = F.concat(F.lit("=== ENTITIES ===\n"), F.array_join("x.line", "\n"), F.lit("\n\n=== RELATIONSHIPS ===\n"), F.array_join("y.line", "\n"))
    return a.join(b, how="cross").select(text.alias("context"))  # one row each
