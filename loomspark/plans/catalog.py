"""Registered queries over the test tables and their SQL.

The graph of these queries: brands and suppliers are entities, line items relate them. Names are
spelt in several ways, so that normalisation and merging matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.answers import extraction, verdict
from loomspark.functions.html import page
from loomspark.functions.text import TERMS_PROMPT, clamp_score, clean_text, entity_lines, normalize_name, overall_score, prompt, split_reasoning, strip_think, truncate, window_chunks
from loomspark.operators import communities, evaluation
from loomspark.operators.components import components
from loomspark.operators.graph import Graph, build_edges, build_entity_map, build_graph, build_nodes, context, degrees, incident_edges, induced, list_entities, neighbours, rejected_relationships, relation_counts, statistics, type_counts, undirected
from loomspark.operators.merge import entity_rows, merge_entities, merge_relationships, relationship_rows
from loomspark.operators.retrieval import match_terms, nearest, node_tokens, source_chunks
from loomspark.plans.chat import clear, history, latest_question, visible
from loomspark.plans.index_build import build
from loomspark.plans import providers
from loomspark.plans.search import Corpus
from loomspark.sources.corpus import empty_extractions, failed_chunks, filter_questions, read_sitemaps
from loomspark.sources.store import cache_delete, cache_lookup, page_files
from loomspark.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), F.replace("p_brand", F.lit("#"), F.lit("_")))).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-")))
    parts = p.select(brand.alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), F.col("p_name").alias("description"), F.concat(F.lit("p_chunk_"), F.col("p_partkey").cast("string")).alias("source_chunk"), F.col("p_partkey").alias("ord"))
    s = table(spark, sf_dir, "supplier")
    return parts.unionByName(s.select(F.col("s_name").alias("name"), F.lit("Supplier").alias("type"), F.lit("").alias("description"), F.concat(F.lit("s_chunk_"), F.col("s_suppkey").cast("string")).alias("source_chunk"), (F.col("s_suppkey") + 10_000_000).alias("ord")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    brand = F.when(F.col("l_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    return x.select(brand.alias("source"), F.col("s_name").alias("target"), F.concat(F.lit("R_"), F.col("l_returnflag")).alias("relation_type"), F.concat(F.col("l_linestatus"), F.col("l_returnflag")).alias("description"), F.col("l_quantity").alias("weight"), F.concat(F.lit("l_chunk_"), F.col("l_orderkey").cast("string")).alias("source_chunk"), ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1000 * 1000 + F.col("l_suppkey") % 1000).alias("ord"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(entities(spark, sf_dir), relations(spark, sf_dir))


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """graph() with nodes and edges written once, for queries that read them several times: all line items are merged into them."""
    nodes = written(build_nodes(entities(spark, sf_dir)), "nodes")
    return Graph(nodes, written(build_edges(relations(spark, sf_dir), nodes), "edges"), build_entity_map(entities(spark, sf_dir)))


ENT = """ent as (select case p_partkey % 3 when 0 then upper(p_brand) when 1 then '  ' || replace(p_brand, '#', '_') else replace(p_brand, '#', '-') end as name, split_part(p_type, ' ', 1) as type, p_name as description, 'p_chunk_' || p_partkey as source_chunk, p_partkey as ord from part
  union all select s_name, 'Supplier', '', 's_chunk_' || s_suppkey, s_suppkey + 10000000 from supplier),
 rel as (select case when l_orderkey % 7 = 0 then 'unknown' else replace(p_brand, '#', ' ') end as source, s_name as target, 'R_' || l_returnflag as relation_type, l_linestatus || l_returnflag as description, l_quantity as weight, 'l_chunk_' || l_orderkey as source_chunk, (l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey % 1000 * 1000 + l_suppkey % 1000 as ord
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""
NORM = "translate(lower(trim({0})), '_-', '  ')"
FOLD = "list_reduce(list_prepend('', list(description order by ord)), lambda acc, d: case when d = '' or contains(acc, d) then acc else trim(acc || ' ' || d) end)"
NODES = f"""nodes as (select {NORM.format('name')} as node_id, arg_max(name, ord) as name, arg_max(type, ord) as type, arg_max(description, ord) as description, arg_max(source_chunk, ord) as source_chunk, min(ord) as ord from ent group by 1)"""
EDGES = f"""edges as (select {NORM.format('source')} as src, {NORM.format('target')} as dst, arg_min(relation_type, ord) as relation_type, arg_min(description, ord) as description, arg_min(source_chunk, ord) as source_chunk, sum(weight) as weight, min(ord) as ord
  from rel where {NORM.format('source')} in (select node_id from nodes) and {NORM.format('target')} in (select node_id from nodes) group by 1, 2)"""
UND = "und as (select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from edges group by 1, 2)"
DEG = "deg as (select n.node_id, count(e.node_id) as degree from nodes n left join (select unnest([a, b]) as node_id from und) e using (node_id) group by 1)"
G = f"with {ENT}, {NODES}, {EDGES}, {UND}, {DEG}"


@query(f"with {ENT} select {NORM.format('name')} as node_id, arg_min(name, ord) as name, arg_min(type, ord) as type, {FOLD} as description, arg_min(source_chunk, ord) as source_chunk, min(ord) as ord from ent group by {NORM.format('name')}, lower(type)")
def a1_merge_entities(spark, d):  # noqa: ANN001, ANN201
    return merge_entities(entities(spark, d))


@query(f"with {ENT} select {NORM.format('source')} as src, {NORM.format('target')} as dst, arg_min(source, ord) as source, arg_min(target, ord) as target, arg_min(relation_type, ord) as relation_type, {FOLD} as description, sum(weight) as weight, arg_min(source_chunk, ord) as source_chunk, min(ord) as ord from rel group by 1, 2, lower(relation_type)")
def a2_merge_relationships(spark, d):  # noqa: ANN001, ANN201
    return merge_relationships(relations(spark, d))


@query(f"with {ENT}, {NODES} select * from nodes")
def a4_nodes(spark, d):  # noqa: ANN001, ANN201
    return build_nodes(entities(spark, d))


@query(f"with {ENT} select {NORM.format('name')} as node_id, arg_min(name, ord) as name, arg_min(type, ord) as type, arg_min(source_chunk, ord) as source_chunk, {FOLD} as description, min(ord) as ord from ent group by 1")
def a4_entity_map(spark, d):  # noqa: ANN001, ANN201
    return build_entity_map(entities(spark, d))


@query(f"with {ENT}, {NODES}, {EDGES} select * from edges")
def a5_directed_edges(spark, d):  # noqa: ANN001, ANN201
    return build_edges(relations(spark, d), build_nodes(entities(spark, d)))


@query(f"{G} select * from und")
def a6_undirected_edges(spark, d):  # noqa: ANN001, ANN201
    return undirected(graph(spark, d).edges)


@query(f"{G} select * from deg")
def a7_degrees(spark, d):  # noqa: ANN001, ANN201
    return degrees(graph(spark, d))


@query(f"{G} select type, count(*) as n from nodes group by 1")
def a8_type_counts(spark, d):  # noqa: ANN001, ANN201
    return type_counts(build_nodes(entities(spark, d)))


@query(f"{G} select relation_type, count(*) as n from edges group by 1")
def a9_relation_counts(spark, d):  # noqa: ANN001, ANN201
    return relation_counts(graph(spark, d).edges)


@query(
    f"""{G.replace('with ', 'with recursive ', 1)}, adj as (select src as x, dst as y from edges union select dst, src from edges), reach(node_id, seen) as (select node_id, node_id from nodes union select r.node_id, y from reach r join adj on x = r.seen),
 low as (select node_id, min(seen) as component from reach group by 1)
 select n as num_nodes, m as num_edges, (select count(distinct component) from low) as num_components, 2 * m / greatest(n, 1) as avg_degree, 2 * m / (n * (n - 1)) as density from (select (select count(*) from nodes) as n, (select count(*) from und) as m)"""
)
def a10_statistics(spark, d):  # noqa: ANN001, ANN201
    return statistics(stored_graph(spark, d))


@query(f"{G} select * from rel where {NORM.format('source')} not in (select node_id from nodes) or {NORM.format('target')} not in (select node_id from nodes)")
def j2_rejected_relationships(spark, d):  # noqa: ANN001, ANN201
    return rejected_relationships(relations(spark, d), build_nodes(entities(spark, d))).drop("src", "dst")


@query(
    f"""{G}, adj as (select src as x, dst as y from edges union select dst, src from edges), seeds as (select node_id from nodes where ord % 50 = 0),
 h1 as (select distinct s.node_id as seed, y as node_id from seeds s join adj on x = s.node_id where y <> s.node_id), h2 as (select distinct seed, y as node_id from h1 join adj on x = h1.node_id where y <> seed)
 select seed, node_id, min(hop) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) group by 1, 2"""
)
def j3_neighbours(spark, d):  # noqa: ANN001, ANN201
    g = graph(spark, d)
    return neighbours(g.edges, g.nodes.filter("ord % 50 = 0"), 2)


@query(f"{G} select src, dst, weight from edges where src in (select node_id from nodes where ord % 2 = 1) and dst in (select node_id from nodes where ord % 2 = 1)")
def j4_induced_subgraph(spark, d):  # noqa: ANN001, ANN201
    g = graph(spark, d)
    return induced(g, g.nodes.filter("ord % 2 = 1")).edges.select("src", "dst", "weight")


@query(f"{G} select *, 'outgoing' as direction from edges where src = 'brand 13' union all select *, 'incoming' from edges where dst = 'brand 13'")
def j5_incident_edges(spark, d):  # noqa: ANN001, ANN201
    return incident_edges(graph(spark, d).edges, "brand 13")


@query(
    f"""{G}, terms(term_pos, term) as (values (0, 'Brand_13'), (1, 'brand supplier'), (2, 'no such thing 13')), w as (select term_pos, term, {NORM.format('term')} as key from terms),
 exact as (select term_pos, term, node_id, len(list_distinct(string_split(key, ' '))) as overlap, 1.0::double as score, 1 as rank from w join nodes on key = node_id),
 tok as (select node_id, ord, len(list_distinct(list_filter(regexp_split_to_array(node_id, '\\s+'), lambda x: x <> ''))) as n_words, unnest(list_distinct(list_filter(regexp_split_to_array(node_id, '\\s+'), lambda x: x <> ''))) as token from nodes),
 hits as (select term_pos, term, node_id, n_words, ord, count(*) as overlap from (select term_pos, term, unnest(list_distinct(string_split(key, ' '))) as token from w where term_pos not in (select term_pos from exact)) join tok using (token) where length(token) > 2 group by all),
 ranked as (select *, row_number() over (partition by term_pos order by overlap desc, overlap / n_words desc, ord) as rank from hits)
 select * from exact union all select term_pos, term, node_id, overlap, overlap / n_words, rank from ranked where rank <= 5"""
)
def j7_match_terms(spark, d):  # noqa: ANN001, ANN201
    terms = spark.createDataFrame([(0, "Brand_13"), (1, "brand supplier"), (2, "no such thing 13")], "term_pos int, term string")
    return match_terms(terms, build_nodes(entities(spark, d)))


@query(f"{G} select node_id, token, n_words from (select node_id, len(list_distinct(list_filter(regexp_split_to_array(node_id, '\\s+'), lambda x: x <> ''))) as n_words, unnest(list_distinct(list_filter(regexp_split_to_array(node_id, '\\s+'), lambda x: x <> ''))) as token from nodes)")
def j7_node_tokens(spark, d):  # noqa: ANN001, ANN201
    return node_tokens(build_nodes(entities(spark, d))).select("node_id", "token", "n_words")


@query(f"{G} select f.node_id, f.name, f.type, degree from (select * from nodes where lower(type) = 'supplier' order by ord limit 20) f join deg using (node_id)")
def q11_list_entities(spark, d):  # noqa: ANN001, ANN201
    return list_entities(stored_graph(spark, d), 20, "SUPPLIER").select("node_id", "name", "type", "degree")


@query(
    f"""{G}, e as (select string_agg('- ' || name || ' (' || type || '): ' || description[:200], chr(10) order by degree desc, ord) as x from (select * from nodes join deg using (node_id) order by degree desc, ord limit 20)),
 r as (select string_agg('- (' || s || ') --[' || relation_type || ']--> (' || t || ')' || case when description <> '' then ': ' || description else '' end, chr(10) order by weight desc, ord) as y from (select e.*, a.name as s, b.name as t from (select * from edges order by weight desc, ord limit 30) e join nodes a on src = a.node_id join nodes b on dst = b.node_id))
 select '=== ENTITIES ===' || chr(10) || x || chr(10) || chr(10) || '=== RELATIONSHIPS ===' || chr(10) || y as context from e, r"""
)
def q5_graph_context(spark, d):  # noqa: ANN001, ANN201
    return context(stored_graph(spark, d))


@query(f"select p_partkey, {NORM.format(chr(39) + ' ' + chr(39) + ' || p_brand')} as key from part")
def p1_normalize_names(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select("p_partkey", normalize_name(F.concat(F.lit(" "), "p_brand")).alias("key"))


@query("select conv_id, turn, trim(regexp_replace('<think>' || role || chr(10) || '</think> ' || text, '<think>.*?</think>', '', 'gs'), chr(10) || ' ') as answer from conversations")
def p2_strip_think(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "conversations").select("conv_id", "turn", strip_think(F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), "text")).alias("answer"))


@query("select conv_id, turn, role as chain, trim(text, chr(10) || ' ') as final from conversations")
def p3_split_reasoning(spark, d):  # noqa: ANN001, ANN201
    x = split_reasoning(F.concat(F.lit("<think>"), "role", F.lit("</think>"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", "x.*")


@query("select event_id, greatest(1, least(5, round_even(value / 10, 0)::int)) as score, (greatest(1, least(5, round_even(value / 10, 0)::int)) + 3) / 2 as overall from events")
def p7_judge_scores(spark, d):  # noqa: ANN001, ANN201
    s = clamp_score(F.col("value") / 10)
    return table(spark, d, "events").select("event_id", s.alias("score"), overall_score(s, F.lit(None).cast("int"), F.lit(3)).alias("overall"))


@query("select doc_id, i as chunk_idx, doc_id || '_chunk_' || i as chunk_id, substr(text, i * 1300 + 1, 1500) as text from (select *, unnest(range(greatest(1, ceil((length(text) - 200) / 1300)::bigint))) as i from documents)")
def p13_window_chunks(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "documents").select("doc_id", F.posexplode(window_chunks(F.col("text"))).alias("i", "text"))
    return x.select("doc_id", F.col("i").cast("long").alias("chunk_idx"), F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("i").cast("string")).alias("chunk_id"), "text")


@query("select distinct 'c' || event_id % 50 as chunk_id from events where event_type = 'click'")
def s10_failed_chunks(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    line = F.concat(F.lit("WARN extraction failed for chunk c"), (F.col("event_id") % 50).cast("string"), F.lit(": timeout"))
    return failed_chunks(e.select(F.when(F.col("event_type") == "click", line).otherwise("INFO ok").alias("value")))


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) select conv_id::varchar as session_id, coalesce(string_agg(case role when 'user' then 'User: ' else 'Assistant: ' end || text, chr(10) order by turn) filter (r between 2 and 11), '(No previous conversation)') as history from r group by conv_id")
def w7_history(spark, d):  # noqa: ANN001, ANN201
    return history(messages(spark, d))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("select conv_id::varchar as session_id, arg_max(text, turn) as question, max(turn) as turn from conversations where role = 'user' group by 1")
def w8_latest_question(spark, d):  # noqa: ANN001, ANN201
    return latest_question(messages(spark, d))


@query("select conv_id, turn, case when length(text) > 300 then text[:300] || '...' else text end as snippet from conversations")
def p12_truncate(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "conversations").select("conv_id", "turn", truncate(F.col("text"), 300, "...").alias("snippet"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("difficulty"), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")).alias("question_type"), (F.col("event_id") % 9 != 0).alias("success"), (F.col("event_id") % 5 / 4).alias("precision"), (F.col("event_id") % 8 / 8).alias("recall"), (F.col("event_id") % 16 / 16).alias("f1"), (F.col("event_id") % 32 / 32).alias("coverage"), F.floor(v).cast("double").alias("latency_ms"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4 + 1.0).alias("judge"))


RES = "res as (select event_type as category, 'd' || user_id % 3 as difficulty, 't' || event_id % 4 as question_type, event_id % 9 <> 0 as success, event_id % 5 / 4 as precision, event_id % 8 / 8 as recall, event_id % 16 / 16 as f1, event_id % 32 / 32 as coverage, floor(value)::double as latency_ms, case when event_id % 3 = 0 then event_id % 4 + 1.0 end as judge from events)"


@query(f"with {RES}, ok as (select * from res where success) select (select count(*) from ok) as successes, (select avg(recall) from ok) as recall_mean, (select median(recall) from ok) as recall_median, (select list_sort(list(latency_ms))[floor(count(*) * 0.95)::bigint + 1] from ok) as latency_p95, (select min(latency_ms) from ok) as latency_min, (select max(latency_ms) from ok) as latency_max, (select count(judge) from ok) as judged, count(*) as total from res")
def a20_aggregate(spark, d):  # noqa: ANN001, ANN201
    return evaluation.aggregate(results(spark, d)).select("successes", "recall_mean", "recall_median", "latency_p95", "latency_min", "latency_max", "judged", "total")


@query(f"with {RES} select dimension, value, count(*) as n, round(avg(success::int), 9) as success_rate, round(avg(recall) filter (success), 9) as recall_mean from (select 'category' as dimension, category as value, * from res union all select 'difficulty', difficulty, * from res union all select 'question_type', question_type, * from res) group by 1, 2 having count(*) filter (success) > 0")
def a22_breakdowns(spark, d):  # noqa: ANN001, ANN201
    return evaluation.breakdowns(results(spark, d)).select("dimension", "value", "n", F.round("success_rate", 9).alias("success_rate"), F.round("recall_mean", 9).alias("recall_mean"))


@query("select p_partkey, ((contains(lower(p_type), 'brass'))::int + (contains(lower(p_type), 'a') and contains(lower(p_type), 'e'))::int) / 2 as coverage from part")
def j14_keyword_coverage(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select("p_partkey", evaluation.keyword_coverage(F.col("p_type"), F.array(F.lit("BRASS"), F.lit("a e"))).alias("coverage"))


@query()
def p18_page_data(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", page("html", "url").alias("page")).select("page_id", "page.*")


@query()
def a13_communities(spark, d):  # noqa: ANN001, ANN201
    return communities.hierarchy(stored_graph(spark, d), algorithm="louvain")


@query()
def a14_leiden_communities(spark, d):  # noqa: ANN001, ANN201
    return communities.hierarchy(stored_graph(spark, d), algorithm="leiden")


@query()
def q6_community_contexts(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.contexts(g, written(communities.hierarchy(g), "membership"))


_BUILT: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The index of the documents of a folder: built and stored once in an application, then read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = build(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return _BUILT[key]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, parsed): one parsed extraction for each part, with blank names and relationships to strangers."""
    e = lambda n, t, x: F.struct(n.alias("name"), t.alias("type"), x.alias("description"))
    r = lambda a, b, t, x: F.struct(a.alias("source"), b.alias("target"), t.alias("relation_type"), x.alias("description"))
    none = F.lit(None).cast("string")
    brand, name, kind = F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.col("p_name"), F.col("p_type")
    made = F.when(F.col("p_size") % 2 == 0, none).otherwise("made of")
    entities_ = F.array(e(brand, F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(kind), none), e(F.lit("  "), kind, kind), e(name, none, kind))
    relations_ = F.array(r(F.upper("p_brand"), name, made, kind), r(F.lit("nobody"), name, made, kind))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.struct(entities_.alias("entities"), relations_.alias("relationships")).alias("parsed"))


@query("select p_brand as name, case when p_size % 3 = 0 then 'Concept' else p_type end as type, '' as description, 'c' || p_partkey as source_chunk, 0 as item from part union all select p_name, 'Concept', p_type, 'c' || p_partkey, 2 from part")
def p9_entity_rows(spark, d):  # noqa: ANN001, ANN201
    return entity_rows(answers(spark, d))


@query("select upper(p_brand) as source, p_name as target, case when p_size % 2 = 0 then 'RELATED_TO' else 'MADE OF' end as relation_type, p_type as description, 1.0::double as weight, 'c' || p_partkey as source_chunk, 0 as item from part")
def p10_relationship_rows(spark, d):  # noqa: ANN001, ANN201
    return relationship_rows(answers(spark, d))


@query("select 'c' || p_partkey as chunk_id from part where p_partkey % 3 < 2")
def s11_empty_extractions(spark, d):  # noqa: ANN001, ANN201
    key = F.substring("chunk_id", 2, 20).cast("long") % 3
    none = F.transform("parsed.entities", lambda e: e), F.transform("parsed.relationships", lambda r: r)
    empty = F.struct(F.slice(none[0], 1, 0).alias("entities"), F.slice(none[1], 1, 0).alias("relationships"))
    return empty_extractions(answers(spark, d).withColumn("parsed", F.when(key == 1, empty).when(key == 2, F.col("parsed"))))


@query("select conv_id || '_' || turn as chunk_id, coalesce(text in (select text from conversations where turn % 4 = 2), false) as hit from conversations")
def j16_cache_hits(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "conversations")
    status = F.when(F.col("turn") % 4 == 0, "failed").otherwise("ok")
    cache = c.filter("turn % 2 = 0").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("parsed"), status.alias("status"), F.lit("v1").alias("provider"))
    hits, misses = cache_lookup(c.select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text"), cache, "v1")
    return hits.select("chunk_id", F.lit(True).alias("hit")).unionByName(misses.select("chunk_id", F.lit(False).alias("hit")))


@query("select 'c' || event_id as chunk_id, user_id from events where event_type is distinct from 'click'")
def k11_cache_delete(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), "user_id", "event_type")
    return cache_delete(e.drop("event_type"), e.filter("event_type = 'click'"))


@query("select p_partkey, p_name as name, case p_partkey % 2 when 0 then 'ok' else 'repaired' end as status from part")
def p5_tolerant_json(spark, d):  # noqa: ANN001, ANN201
    good = F.concat(F.lit('<think>{</think>```json\n{"entities": [{"name": "'), "p_name", F.lit('", "type": "T"}], "relationships": []}\n```'))
    broken = F.concat(F.lit("So: {entities: [{'name': '"), "p_name", F.lit("', 'type': 'T',}], relationships: ["))
    x = table(spark, d, "part").select("p_partkey", extraction(F.when(F.col("p_partkey") % 2 == 0, good).otherwise(broken)).alias("x"))
    return x.select("p_partkey", F.col("x.entities")[0]["name"].alias("name"), "x.status")


@query("select event_id, coalesce(event_type, 'none') || '|user ' || user_id as names from events")
def p11_entity_lines(spark, d):  # noqa: ANN001, ANN201
    said = F.concat(F.lit("- "), F.coalesce("event_type", F.lit("none")), F.lit("\n\n  \u2022 user "), F.col("user_id").cast("string"), F.lit("  \n1. x"))
    return table(spark, d, "events").select("event_id", F.array_join(entity_lines(said), "|").alias("names"))


@query("select conv_id, turn, 'Name the entities this question asks about, one a line.' || chr(10) || chr(10) || coalesce(text, '') as prompt from conversations")
def p25_prompts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "conversations").select("conv_id", "turn", prompt(TERMS_PROMPT, question=F.col("text")).alias("prompt"))


@query("select conv_id::varchar as session_id, turn, role, text as content from conversations where conv_id <> 1")
def q9_cleared_session(spark, d):  # noqa: ANN001, ANN201
    return visible(clear(messages(spark, d), "1"))


@query("select event_id::varchar as id, event_type as category from events where event_type = 'click' order by id limit 10")
def f9_filter_questions(spark, d):  # noqa: ANN001, ANN201
    q = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("category"))
    return filter_questions(q, category="click", first=10)


@query(f"with {RES}, v as (select unnest(['click', 'no such']) as value) select 'category' as dimension, v.value, count(event_type) as n from v left join events on event_type = v.value group by 2 union all select 'difficulty', 'd1', count(*) from res where difficulty = 'd1'")
def a26_dataset_summary(spark, d):  # noqa: ANN001, ANN201
    return evaluation.dataset_summary(results(spark, d), {"category": ["click", "no such"], "difficulty": ["d1"]})


def _dealt(g: Graph) -> DataFrame:
    """A membership that SQL can state: seven communities by node order."""
    return g.nodes.select(F.lit(0).alias("level"), F.concat(F.lit("k"), (F.col("ord") % 7).cast("string")).alias("community"), "node_id")


@query(
    f"""{G}, x as (select 'k' || ord % 7 as community, n.*, degree from nodes n join deg using (node_id)),
 kinds as (select community, type, count(*) as c, min(ord) as o from x group by all), kind as (select community, arg_min(type, struct_pack(c := -c, o := o)) as type, sum(c)::bigint as n from kinds group by 1),
 top as (select community, string_agg(name, ', ' order by degree desc, ord) as names from (select *, row_number() over (partition by community order by degree desc, ord) as r from x) where r <= 3 group by 1)
 select 0 as level, community, type || ' cluster: ' || names as title, n from kind join top using (community)"""
)
def a18_titles(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.titles(g, _dealt(g))


@query(f"{G}, m as (select node_id, 'k' || ord % 7 as c from nodes) select least(p.c, q.c) as a, greatest(p.c, q.c) as b, count(*)::double as weight from und join m p on und.a = p.node_id join m q on und.b = q.node_id where p.c <> q.c group by 1, 2")
def j10_community_edges(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.community_edges(undirected(g.edges), _dealt(g))


@query(
    f"""{G}, k as (select source_chunk as chunk_id, min(struct_pack(g := (ord > 2)::int, r := case when ord <= 2 then ord else 0 end, o := ord)) as o from nodes where source_chunk <> '' group by 1)
 select chunk_id, row_number() over (order by o) as pos from k order by o limit 5"""
)
def j8_source_chunks(spark, d):  # noqa: ANN001, ANN201
    nodes = build_nodes(entities(spark, d))
    return source_chunks(nodes.filter("ord <= 2").select("node_id", F.col("ord").alias("match_rank")), nodes.select("node_id"), nodes)


@query("with m as (select 'm' || page_id as map, replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '&amp;', '&') as url from pages where url is not null) select distinct case when map in ('m1', 'm2') then 'root' else map end as root, url from m")
def s13_sitemaps(spark, d):  # noqa: ANN001, ANN201
    leaves = table(spark, d, "pages").select(F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("\n</loc></url></urlset>")).alias("xml"))
    root = spark.createDataFrame([("root", "<sitemapindex><loc>m1</loc><loc>m2</loc></sitemapindex>")], "url string, xml string")
    return read_sitemaps(leaves.unionByName(root))


FLAGSHIP = q5_graph_context
