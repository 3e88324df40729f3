import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import communities, graph, merge, retrieval
from loomspark.operators.components import components, grown

ENTITY = "name string, type string, description string, source_chunk string, ord long"
RELATION = "source string, target string, relation_type string, description string, weight double, source_chunk string, ord long"


def entities(spark):
    rows = [("CPF LIFE", "Scheme", "a b", "c1", 1), ("cpf-life", "scheme", "b", "c2", 2), ("cpf_life", "Scheme", "c", "c3", 3), ("cpf life", "Grant", "d2", "c4", 4), ("A", "T", "", "c5", 5), ("B", "T", None, "c6", 6), ("C", "T", "", "c7", 7)]
    return spark.createDataFrame(rows, ENTITY)


def relations(spark):
    rows = [("A", "B", "R1", "x", 1.0, "c", 1), ("A", "B", "R2", "y", 1.0, "c", 2), ("B", "A", "R3", "", 1.0, "c", 3), ("A", "A", "R4", "", 1.0, "c", 4), ("A", "nobody", "R5", "", 1.0, "c", 5)]
    return spark.createDataFrame(rows, RELATION)


def test_merge(spark):
    got = {(r.node_id, r.type): r for r in merge.merge_entities(entities(spark)).collect()}
    assert got["cpf life", "Scheme"].description == "a b c" and got["cpf life", "Scheme"].name == "CPF LIFE"
    assert ("cpf life", "Grant") in got
    r = merge.merge_relationships(relations(spark))
    assert r.count() == 5 and r.agg({"weight": "sum"}).first()[0] == 5.0


def test_build(spark):
    g = graph.build_graph(entities(spark), relations(spark))
    n = {r.node_id: r for r in g.nodes.collect()}
    assert (n["cpf life"].type, n["cpf life"].description, n["cpf life"].ord) == ("Grant", "d2", 1)
    m = {r.node_id: r for r in g.entity_map.collect()}
    assert (m["cpf life"].type, m["cpf life"].description) == ("Scheme", "a b c d2")
    e = {(r.src, r.dst): r for r in g.edges.collect()}
    assert len(e) == 3 and (e["a", "b"].weight, e["a", "b"].relation_type) == (2.0, "R1")
    u = {(r.a, r.b): r.weight for r in graph.undirected(g.edges).collect()}
    assert u == {("a", "b"): 3.0, ("a", "a"): 1.0}
    assert {r.node_id: r.degree for r in graph.degrees(g).collect()} == {"a": 3, "b": 1, "c": 0, "cpf life": 0}
    s = graph.statistics(g).first()
    assert (s.num_nodes, s.num_edges, s.num_components) == (4, 2, 3)
    assert graph.rejected_relationships(relations(spark), g.nodes).count() == 1
    assert graph.incident_edges(g.edges, "a").count() == 4
    assert [r.node_id for r in graph.list_entities(g, 2).collect()] == ["a", "cpf life"]
    assert graph.context(g).first()[0].startswith("=== ENTITIES ===\n- A (T): ")


def path(spark):
    nodes = spark.createDataFrame([(x, x, "T", "", "", i) for i, x in enumerate("abcd")], "node_id string, name string, type string, description string, source_chunk string, ord long")
    edges = spark.createDataFrame([(a, b, "R", "", 1.0, "", i) for i, (a, b) in enumerate(("ab", "bc", "cd"))], "src string, dst string, relation_type string, description string, weight double, source_chunk string, ord long")
    return graph.Graph(nodes, edges, nodes)


def test_hops(spark):
    g = path(spark)
    for k, want in ((0, set()), (1, {"b"}), (2, {"b", "c"}), (9, {"b", "c", "d"})):
        assert {r.node_id for r in graph.neighbours(g.edges, g.nodes.filter("node_id = 'a'"), k).collect()} == want
    assert graph.induced(g, g.nodes.filter("ord < 2")).edges.count() == 1


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_all_orders(spark):
    from loomspark.plans import catalog, catalog_more  # noqa: F401  the second registers its queries with the first

    d = "/root/testdata/sf0.01"
    pairs = [(r.o_custkey, r.o_orderkey + 1_000_000_000) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in catalog.QUERIES["a12_components"](spark, d).collect()}
    assert got == {x: find(x) for x in parent}


def test_louvain_beats_label_free_split(spark):
    a = np.array([0, 0, 1, 3, 3, 4, 2])
    b = np.array([1, 2, 2, 4, 5, 5, 3])
    member = communities.louvain(a, b, np.ones(7), 7.0, 1.0, 42)
    assert len(set(member[:3])) == 1 and len(set(member[3:])) == 1 and member[0] != member[3]


def test_components_of_a_growing_graph(spark):
    """After each of several batches the same as a full run; a batch given twice changes nothing."""
    r, edges, state = random.Random(3), [], None
    for i in range(4):
        batch = [(r.randrange(80), r.randrange(80)) for _ in range(14)] + [(None, 1), (5, None), (7, 7)]
        edges += batch
        for _ in range(1 + (i == 2)):
            state = grown(spark.createDataFrame(batch, "src long, dst long"), before=state)
        full = components(spark.createDataFrame(edges, "src long, dst long"))
        assert sorted(map(tuple, state.components(spark).collect())) == sorted(map(tuple, full.collect()))


def test_hierarchy(spark):
    g = path(spark)
    m = communities.hierarchy(g, min_size=2)
    assert {r.node_id for r in m.filter("level = 0").collect()} == set("abcd")
    for r in communities.contexts(g, m).collect():
        assert r.context.startswith(f"Community: {r.title}\nLevel: {r.level}\nNumber of entities: {r.n}")
    assert communities.hierarchy(g, min_size=5).select("community").distinct().count() == 1
    assert communities.hierarchy(g, min_size=2, algorithm="leiden").filter("level > 0").count() == 0


def test_leiden_splits_until_small(spark):
    pairs = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}", 1.0) for i in range(999)], "a string, b string, weight double")
    sizes = communities.detect(pairs, max_size=3).groupBy("community").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 3 and sizes.agg({"count": "sum"}).first()[0] == 1000


def test_large_component_is_coarsened_by_all_tasks(spark):
    edges = [(10 * c + i, 10 * c + j) for c in range(16) for i in range(8) for j in range(i)]
    edges += [(10 * c, 10 * ((c + 1) % 16) + 1) for c in range(16)]  # a ring of cliques
    edges += [(0, 1000 + i) for i in range(100)] + [(5000, 5001), (5001, 5002)]  # a hub, and a component of its own
    name = "n{:04}".format
    pairs = spark.createDataFrame([(*sorted((name(x), name(y))), 1.0) for x, y in edges], "a string, b string, weight double")
    nodes = {name(x) for e in edges for x in e}

    def checked(**options):
        found = communities.detect(pairs, **options).collect()
        part = {r.node_id: r.community for r in found}
        assert len(found) == len(part) and set(part) == nodes
        low = components(pairs.join(spark.createDataFrame(list(part.items()), "a string, ca string"), "a").join(spark.createDataFrame(list(part.items()), "b string, cb string"), "b").filter("ca = cb"), "a", "b")
        low = {r.node: r.component for r in low.collect()}
        assert all(low.get(x, x) == c for x, c in part.items())  # connected, and named by the smallest member
        return part, communities.modularity(pairs, spark.createDataFrame(list(part.items()), "node_id string, community string")).first()[0]

    _, whole = checked()
    part, ours = checked(task_pairs=20)
    assert ours > 0.99 * whole and part[name(5000)] == part[name(5002)] == name(5000)
    part, _ = checked(task_pairs=0, max_size=12)  # no task clusters, the sets are the communities
    assert max(list(part.values()).count(c) for c in set(part.values())) <= 12


def test_unequal_communities_by_all_tasks(spark):
    """Communities of 8 to 70 nodes with edges between them: by all tasks within 1 % of the sequential modularity."""
    r, groups, n = random.Random(1), [], 0
    for g in range(12):
        size = int(5 * 1.25**g) + 3
        groups.append(range(n, n + size))
        n += size
    edges = {tuple(sorted((x, r.choice(g)))) for g in groups for x in g for _ in range(5)}
    edges |= {tuple(sorted((r.randrange(n), r.randrange(n)))) for _ in range(len(edges) // 5)}
    pairs = spark.createDataFrame([(f"n{x:05}", f"n{y:05}", 1.0) for x, y in sorted(edges) if x != y], "a string, b string, weight double")
    whole, ours = (communities.modularity(pairs, communities.detect(pairs, max_size=n, task_pairs=t)).first()[0] for t in (1 << 30, 500))
    assert ours > 0.99 * whole > 0.5


def test_strays_of_early_rounds_are_settled(spark):
    """Nodes in the wrong community move one by one, what they held together comes apart, and a full community takes no more."""
    cliques = {"a": 8, "b": 8, "p": 3, "q": 3}
    edges = [(f"{g}{i}", f"{g}{j}") for g, n in cliques.items() for j in range(n) for i in range(j)]
    edges += [("a0", "b0"), ("a6", "z"), ("a7", "z"), ("p0", "z"), ("q0", "z"), ("a1", "z"), ("a2", "z"), ("a3", "z")]
    pairs = spark.createDataFrame([(a, b, 1.0, 1, 1) for a, b in edges], "a string, b string, weight double, a_n long, b_n long")
    nodes = sorted({x for e in edges for x in e})
    start = {x: {"a": "a0", "b": "a4", "p": "p0", "q": "p0", "z": "p0"}[x[0]] for x in nodes} | {x: "a4" for x in ("a4", "a5")} | {"b7": "a0"}
    found = spark.createDataFrame(list(start.items()), "node_id string, community string")

    def settled(most):
        return {r.node_id: r.community for r in communities._settled(pairs, found, 1 / (2 * len(edges)), most).collect()}

    assert settled(100) == {x: "a0" if x == "z" else x[0] + "0" for x in nodes}
    held = settled(8)
    assert set(held) == set(nodes) and max(list(held.values()).count(c) for c in held.values()) <= 10  # none grows that holds 8 or more
    assert held["z"] == "p0"


def test_leiden_communities_are_connected():
    def modularity(a, b, part):
        degree = np.bincount(a, minlength=len(part)) + np.bincount(b, minlength=len(part))
        return (part[a] == part[b]).mean() - sum((degree[part == c].sum() / (2 * len(a))) ** 2 for c in np.unique(part))

    ours = louvains = 0.0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 120, (260, 2))
        x = np.unique(np.sort(np.concatenate([x[x[:, 0] != x[:, 1]], [[i, i + 1] for i in range(119)]]), axis=1), axis=0)
        a, b = x[:, 0], x[:, 1]
        member = communities.leiden(a, b, np.ones(len(a)), float(len(a)), 1.0, 42)
        ours += modularity(a, b, member)
        louvains += modularity(a, b, communities.louvain(a, b, np.ones(len(a)), float(len(a)), 1.0, 42))
        for part in (member, communities.hierarchical_leiden(a, b, np.ones(len(a)), float(len(a)), 1.0, 42, 5)):
            low = np.arange(120)
            for _ in range(120):
                for p, q in x[part[a] == part[b]]:
                    low[p] = low[q] = min(low[p], low[q])
            assert len(np.unique(low)) == len(np.unique(part))
    assert ours > 0.99 * louvains


def test_nearest_of_each_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 40)  # several blocks on both sides
    x = np.random.default_rng(1).integers(0, 3, (150, 4)).astype(float)  # with many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 3 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = {}
    for r in retrieval.nearest(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert got == {i: [(j, float(((x[i] - x[j]) ** 2).sum())) for j in sorted(range(150), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]] for i in range(0, 150, 3)}


def test_terms(spark):
    nodes = spark.createDataFrame([("housing grant", 1), ("grant", 2), ("hdb", 3)], "node_id string, ord long")
    terms = spark.createDataFrame([(0, "housing grant scheme"), (1, "HDB")], "term_pos int, term string")
    got = [(r.node_id, r.overlap, r.score) for r in retrieval.match_terms(terms, nodes).orderBy("term_pos", "rank").collect()]
    assert got == [("housing grant", 2, 1.0), ("grant", 1, 1.0), ("hdb", 1, 1.0)]


def test_descriptions_with_outer_spaces_fold_as_they_come(spark):
    rows = [("A", "T", d, f"c{i}", i) for i, d in enumerate(["x ", "x ", "y", "x", "y", None, " z", "x y"])]
    got = merge.merge_entities(spark.createDataFrame(rows, ENTITY)).first().description
    want = ""
    for _, _, d, _, _ in rows:
        if d and d not in want:
            want = (want + " " + d).strip()
    assert got == want


def test_folds_of_many_descriptions(spark):
    """A hot key by its index, others by plain search: both as a loop over the definition."""
    r = random.Random(3)
    words = ["alpha", "be", "gamma delta", "epsilon", " z", "é"]
    rows, want = [], {}
    for i in range(1500):
        name = "hot" if i % 5 else f"n{i % 7}"
        acc = want.get(name, "")
        at, n = r.randrange(max(1, len(acc))), r.choice((1, 5, 8, 20, 40))
        d = None if i % 97 == 0 else acc[at : at + n] if r.random() < 0.4 else " ".join(r.choices(words, k=r.randrange(9))) + r.choice(("", str(i)))
        rows.append((name, "T", d, f"c{i}", i))
        want[name] = acc if not d or d in acc else (acc + " " + d).strip(" ")
    got = {x.node_id: x.description for x in merge.merge_entities(spark.createDataFrame(rows, ENTITY).repartition(5)).collect()}
    assert got == want
    assert len({d for n, _, d, _, _ in rows if n == "hot"}) > merge.FEW
    assert merge.merge_entities(spark.createDataFrame([], ENTITY)).count() == 0


def test_terms_of_frequent_words(spark):
    """With any bound of frequent words the result is the one of all lists."""
    r = random.Random(4)
    words = ["big", "red", "ring", "box", "of", "x1y", "blue", *(f"rare{i}" for i in range(40))]
    weights = [20, 15, 12, 10, 9, 6, 5, *([1] * 40)]
    name = lambda: " ".join(r.choices(words, weights, k=r.randrange(1, 6)))
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(name() for _ in range(300)))], "node_id string, ord long")
    terms = spark.createDataFrame([(i, None if i == 7 else "" if i == 8 else "none " + name()) for i in range(60)], "term_pos int, term string")
    rows = lambda frequent: sorted(map(tuple, retrieval.match_terms(terms, nodes, frequent=frequent).collect()))
    want = rows(10**6)
    assert rows(15) == want and rows(0) == want and len(want) > 200
    assert retrieval.match_terms(terms.limit(0), nodes, frequent=0).count() == 0 == retrieval.match_terms(terms, nodes.limit(0)).count()


def shuffled(spark, run):
    """Rows that the stages of run() write to shuffles."""
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def rows():
        stages = store.stageList(None, False, False, empty, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    run()
    return rows() - before


def test_terms_of_the_same_frequent_words(spark):
    """Terms that ask for the same frequent words do not meet every kind of node one by one."""
    nodes = spark.range(3000).selectExpr("concat('aaa', id % 10, ' bbb', id div 10 % 10, ' ccc', id div 100 % 10) as node_id", "id as ord").groupBy("node_id").agg(F.min("ord").alias("ord"))
    terms = spark.range(1500).selectExpr("cast(id as int) as term_pos", "concat('no aaa', id % 10, ' bbb', id div 10 % 10) as term")
    found = []
    rows = shuffled(spark, lambda: found.extend(retrieval.match_terms(terms, nodes, frequent=20).collect()))
    assert len(found) == 5 * 1500 and {r.overlap for r in found} == {2}
    assert rows < 1500 * 50  # each term meets the 190 kinds of its two words otherwise


def hubs(spark, leaves):
    """Ten hubs, each next to all leaves but one, whose own differ; the first 100 leaves are the seeds."""
    x = spark.range(leaves).crossJoin(spark.range(10).withColumnRenamed("id", "h")).filter("id <> h")
    edges = x.selectExpr("concat('h', h) as src", "concat('l', lpad(id, 4, '0')) as dst")
    return edges, spark.range(100).selectExpr("concat('l', lpad(id, 4, '0')) as node_id")


def test_neighbours_behind_hubs(spark):
    """Seeds that have the same hubs are expanded once, not along every path."""
    edges, seeds = hubs(spark, 600)
    found = []
    rows = shuffled(spark, lambda: found.extend(graph.neighbours(edges, seeds).collect()))
    near = graph.adjacency(edges).collect()
    around = {}
    for r in near:
        around.setdefault(r.node_id, set()).add(r.neighbour)
    want = set()
    for s in (r.node_id for r in seeds.collect()):
        want |= {(s, x, 1) for x in around[s]} | {(s, y, 2) for x in around[s] for y in around[x] if y != s and y not in around[s]}
    assert {(r.seed, r.node_id, r.hop) for r in found} == want and len(found) == len(want)
    assert rows < 40_000


def test_nearest_neighbours_behind_hubs(spark):
    """The first few neighbours are those of all of them, and no hub brings all it has."""
    from pyspark.sql import Window

    from loomspark.plans.search import nearest_neighbours

    edges, seeds = hubs(spark, 600)
    ends = graph.adjacency(edges).groupBy("node_id").agg(F.count("*").alias("degree"))
    degrees = ends.withColumn("ord", F.xxhash64("node_id"))
    r = F.row_number().over(Window.partitionBy("seed").orderBy("hop", F.desc("degree"), "ord"))
    for n, hops in ((25, 2), (25, 3), (5, 2), (1, 1)):
        want = graph.neighbours(edges, seeds, hops).join(degrees, "node_id").withColumn("r", r).filter(F.col("r") <= n).select("seed", "node_id", "hop")
        found = []
        rows = shuffled(spark, lambda: found.extend(nearest_neighbours(edges, seeds, degrees, n, hops).collect()))  # noqa: B023
        assert sorted(map(tuple, found)) == sorted(map(tuple, want.collect())) and len(found) == 100 * n
        assert rows < 60_000  # the pairs within two hops are more


def test_dedup_by_order(spark):
    from loomspark.operators.dedup import first_of_each, without_repeats

    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", None, None, "a", "b"])] + [(2, 0, None), (2, 1, "b")], "g int, o int, v string")
    assert sorted((r.g, r.o) for r in without_repeats(rows, ["g"], ["o"], "v").collect()) == [(1, 0), (1, 2), (1, 4), (1, 5), (2, 0), (2, 1)]
    assert sorted((r.g, r.o) for r in first_of_each(rows, ["g"], F.col("v"), "o").collect()) == [(1, 0), (1, 2), (1, 5), (2, 0), (2, 1)]


def test_entities_of_a_changed_graph_need_no_relationships(spark, monkeypatch):
    from loomspark.plans import catalog_index

    def refused(*_):
        raise AssertionError("relationships were read")

    monkeypatch.setattr(catalog_index, "relations", refused)
    monkeypatch.setattr(catalog_index, "_MADE", {})
    for f in (catalog_index.t5_delta_nodes, catalog_index.t5_delta_entity_map):
        assert f(spark, "/root/testdata/sf0.001").count() > 0


def test_tables_of_a_changed_graph_are_written_once(spark, monkeypatch):
    from loomspark.operators import delta

    names, put = [], delta.written
    monkeypatch.setattr(delta, "written", lambda df, name="table": names.append(name) or put(df, name))
    state = delta.first_state(entities(spark), relations(spark))
    gone = spark.createDataFrame([("c5",), ("c",)], "source_chunk string")
    new, _ = delta.changed_state(state, gone, entities(spark).filter("name = 'A'"), relations(spark).filter("ord < 4"))
    want = delta.first_state(entities(spark), relations(spark).filter("ord < 4"))
    for table in ("entity_rows", "relation_rows", "entities", "relationships", "nodes", "edges", "entity_map"):
        a, b = getattr(new, table), getattr(want, table)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), table
    assert not {"entity-rows", "relation-rows", "entities", "relationships", "nodes"} & set(names)


def test_names_lose_every_unicode_space(spark):
    from loomspark.functions.text import normalize_name, strip

    points = [chr(i) for i in range(1, 0x3100)]
    names = spark.createDataFrame([(c + c + " A_" + c + "-b" + c,) for c in points] + [("",), (" \n",), (None,)], "name string")
    old = F.translate(F.lower(strip(F.col("name"))), "_-", "  ")
    assert names.filter(~old.eqNullSafe(normalize_name(F.col("name")))).count() == 0


def test_stored_graph_does_not_read_line_items_again(spark):
    from loomspark.plans import catalog

    g = catalog.stored_graph(spark, "/root/testdata/sf0.001")
    assert not [f for x in (g.nodes, g.edges) for f in x.inputFiles() if "lineitem" in f]


def test_contexts_rank_the_first_rows_of_a_community_only(spark, capsys):
    g = path(spark)
    members = spark.createDataFrame([(0, "k", x) for x in "abcd"], "level int, community string, node_id string")
    found = communities.contexts(g, members, max_entities=2, max_edges=1)
    assert found.first().context.endswith("\n  ... and 2 more entities\n\nRELATIONSHIPS:\n- (a) --[R]--> (b)\n  ... and 2 more relationships")
    found.explain()
    told = capsys.readouterr().out
    assert "WindowGroupLimit" in told and "count(1) windowspec" not in told


def test_nodes_are_numbered_in_order_of_names(spark):
    names = sorted(f"n{i * 7919 % 1000}" for i in range(1000))
    pairs = spark.createDataFrame([(names[i], names[i * 37 % 1000], 1.0) for i in range(1000)] + [("n1", None, 1.0)], "a string, b string, weight double")
    for parts in (1, 7):
        got = communities._numbered(pairs.repartition(parts)).collect()
        assert sorted((r.id, r.node) for r in got) == list(enumerate(names))


def test_best_moves_by_plain_python(spark):
    rng = random.Random(5)
    links = sorted({(min(x), max(x)) for x in (rng.sample(range(40), 2) for _ in range(120))})
    w = {p: float(rng.randint(1, 5)) for p in links}
    at = {x: rng.randrange(6) for x in range(41)}  # 40 has no link
    k = {x: sum(v for p, v in w.items() if x in p) for x in at}
    mass = {c: sum(k[x] for x in at if at[x] == c) for c in at.values()}
    scale, want = 1 / (2 * sum(w.values())), {}
    for x in at:
        near = {at[x]: 0.0}
        for (a, b), v in w.items():
            if x in (a, b):
                c = at[b if x == a else a]
                near[c] = near.get(c, 0.0) + v
        gain = {c: v - scale * k[x] * (mass[c] - (k[x] if c == at[x] else 0)) for c, v in near.items()}
        want[x] = (max(gain.values()), gain[at[x]])
    ends = spark.createDataFrame([(a, b, v) for (a, b), v in w.items()] + [(b, a, v) for (a, b), v in w.items()], "x long, y long, weight double")
    state = spark.createDataFrame([(x, float(k[x]), c) for x, c in at.items()], "x long, k double, c long")
    asked = spark.createDataFrame([(3,), (40,)], "x long")
    got = {r.x: (r.gain, r.stay) for r in communities._best(ends, state, scale, F.col("c")).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert {r.x for r in communities._best(ends, state, scale, F.col("c"), asked).collect()} == {3, 40}
