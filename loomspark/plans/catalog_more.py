"""Registered queries over pages, stores, communities, searches, evaluation and streams, and their SQL.

Pages are made from parts, so that SQL can state what the reader of HTML has to find in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.answers import repaired_json, verdict
from loomspark.functions.html import page
from loomspark.functions.text import clean_text
from loomspark.functions.url import authority, excluded, is_document, is_page, normalize_url, same_site, should_visit, visit_key
from loomspark.operators import communities, evaluation
from loomspark.operators.components import components
from loomspark.operators.dedup import first_of_each, question_key, without_repeats
from loomspark.operators.graph import Graph, degrees, entity, node, undirected
from loomspark.operators.merge import entity_rows, merge_entities, merge_relationships, relationship_rows
from loomspark.operators.retrieval import nearest
from loomspark.plans import catalog as base
from loomspark.plans import evaluate
from loomspark.plans.catalog import ENT, FOLD, G, NORM, RES, answers, corpus, graph, messages, query, stored_graph, table
from loomspark.plans.index_build import extraction_counts, extractions, load, store
from loomspark.plans.search import Corpus, combined_search, global_search, local_search, most_connected, nearest_neighbours, relevant_nodes
from loomspark.sources import store as stores
from loomspark.sources.corpus import chunk_documents, filter_questions, json_document, read_documents, read_questions
from loomspark.storage import dealt_out, fresh_path, written
from loomspark.streaming.sessions import crawl, crawl_statistics, incremental_extraction, rate_limited, running_history, scrape_counts, scrape_list

QUESTION = "What is Thnting and Eauouon?"


# --- graph and vectors -------------------------------------------------------------------------
@query("""with recursive e as (select o_custkey as a, o_orderkey + 1000000000 as b from orders), und as (select a, b from e union select b, a from e),
 reach(node, seen) as (select a, a from und union select u.b, r.seen from reach r join und u on u.a = r.node)
 select node, min(seen) as component from reach group by 1""")
def a12_components(spark, d):  # noqa: ANN001, ANN201
    return components(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst")))


@query(
    """with q as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0),
 d as (select query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance from embeddings v, q),
 r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
 select query_id, vec_id, round(distance, 6) as distance, rank from r where rank <= 8"""
)
def j12_nearest(spark, d):  # noqa: ANN001, ANN201
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return nearest(v, q, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"{G} select node_id, name, type, description, source_chunk from nodes where node_id = 'brand#13'")
def q13_node(spark, d):  # noqa: ANN001, ANN201
    return node(graph(spark, d), " BRAND#13 ").select("node_id", "name", "type", "description", "source_chunk")


@query(f"with {ENT} select {NORM.format('name')} as node_id, arg_min(name, ord) as name, arg_min(type, ord) as type, {FOLD} as description from ent where {NORM.format('name')} = 'brand 13' group by 1")
def q13_entity(spark, d):  # noqa: ANN001, ANN201
    return entity(graph(spark, d), "Brand-13").select("node_id", "name", "type", "description")


# --- communities on a membership that SQL can state --------------------------------------------
def dealt(g: Graph) -> DataFrame:
    """Two levels: seven communities by node order, in two groups."""
    low = F.concat(F.lit("k"), (F.col("ord") % 7).cast("string"))
    high = F.concat(F.lit("u"), (F.col("ord") % 7 % 2).cast("string"))
    none = F.lit(None).cast("string")
    level0 = g.nodes.select(F.lit(0).alias("level"), low.alias("community"), "node_id", high.alias("parent"))
    return level0.unionByName(g.nodes.select(F.lit(1).alias("level"), high.alias("community"), "node_id", none.alias("parent")))


DEALT = "m as (select 0 as level, 'k' || ord % 7 as community, node_id, 'u' || (ord % 7 % 2) as parent from nodes union all select 1, 'u' || (ord % 7 % 2), node_id, null from nodes)"
TITLES = """x as (select m.level, m.community, n.*, degree from m join nodes n using (node_id) join deg using (node_id)),
 kinds as (select level, community, type, count(*) as c, min(ord) as o from x group by all), kind as (select level, community, arg_min(type, struct_pack(c := -c, o := o)) as type, sum(c)::bigint as n from kinds group by 1, 2),
 top as (select level, community, string_agg(name, ', ' order by degree desc, ord) as names from (select *, row_number() over (partition by level, community order by degree desc, ord) as r from x) where r <= 3 group by 1, 2),
 titles as (select level, community, type || ' cluster: ' || names as title, n from kind join top using (level, community))"""


@query(
    f"""{G}, {DEALT}, {TITLES}, ents as (select level, community, string_agg('- ' || name || ' (' || type || '): ' || description[:200], chr(10) order by r) as e from (select *, row_number() over (partition by level, community order by degree desc, ord) as r from x) where r <= 30 group by 1, 2),
 inner_edges as (select p.level, p.community, a.name as s, b.name as t, e.relation_type, e.weight, e.ord from edges e join m p on e.src = p.node_id join m q on e.dst = q.node_id and p.level = q.level and p.community = q.community join nodes a on e.src = a.node_id join nodes b on e.dst = b.node_id),
 rels as (select level, community, count(*) as n, string_agg('- (' || s || ') --[' || relation_type || ']--> (' || t || ')', chr(10) order by r) filter (r <= 50) as l from (select *, row_number() over (partition by level, community order by weight desc, ord) as r from inner_edges) group by 1, 2)
 select level, community, title, n, 'Community: ' || title || chr(10) || 'Level: ' || level || chr(10) || 'Number of entities: ' || n || chr(10) || chr(10) || 'ENTITIES:' || chr(10) || e || case when n > 30 then chr(10) || '  ... and ' || (n - 30) || ' more entities' else '' end
  || chr(10) || chr(10) || 'RELATIONSHIPS:' || chr(10) || coalesce(l || case when edges > 50 then chr(10) || '  ... and ' || (edges - 50) || ' more relationships' else '' end, '') as context
 from titles join ents using (level, community) left join (select level, community, l, n as edges from rels) using (level, community)"""
)
def q6_contexts(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.contexts(g, written(dealt(g), "dealt"))


@query(f"{G}, {DEALT} select p.level, p.community, e.src, e.dst, e.weight from edges e join m p on e.src = p.node_id join m q on e.dst = q.node_id and p.level = q.level and p.community = q.community")
def j11_intra_edges(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.intra_edges(g.edges, dealt(g)).select("level", "community", "src", "dst", "weight")


@query(f"{G}, {DEALT}, {TITLES} select node_id, case when community in ('k1', 'k3') then 0 else 1 end as level, case when community in ('k1', 'k3') then community else parent end as community, case when community in ('k1', 'k3') then community else parent end || ' told' as summary from m where level = 0")
def j9_first_communities(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    m = written(dealt(g), "dealt")
    told = F.when((F.col("level") == 1) | F.col("community").isin("k1", "k3"), F.concat("community", F.lit(" told"))).otherwise("")
    summaries = communities.titles(g, m).withColumn("summary", told)
    return communities.first_communities(g.nodes.select("node_id"), m, summaries).select("node_id", "level", "community", "summary")


@query(
    f"""{G}, {DEALT}, c as (select node_id, community from m where level = 0), ends as (select node_id, sum(weight) as degree from (select a as node_id, weight from und union all select b, weight from und) group by 1)
 select round((select sum(weight) from und join c p on a = p.node_id join c q on b = q.node_id where p.community = q.community) / (select sum(weight) from und)
  - (select sum(mass * mass) from (select sum(degree) as mass from ends join c using (node_id) group by community)) / (4 * (select sum(weight) from und) ** 2), 9) as modularity"""
)
def a13_modularity(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return communities.modularity(undirected(g.edges), dealt(g).filter("level = 0")).select(F.round("modularity", 9).alias("modularity"))


@query("select 0 as level, 'all' as community, count(*) as n from (values (1), (2))")
def a17_single_community(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    two = Graph(g.nodes.orderBy("ord").limit(2), g.edges, g.entity_map)
    return communities.hierarchy(two).groupBy("level", "community").agg(F.count("*").alias("n"))


ROWS = "rows as (select m.level, m.community as id, string_agg(distinct node_id, '|' order by node_id) as entity_ids, count(distinct node_id) as num_entities, max(parent) as parent_id from m group by 1, 2)"


@query(f"{G}, {DEALT}, {TITLES}, {ROWS}, kids as (select parent as id, string_agg(distinct community, '|' order by community) as child_ids from m where parent is not null group by 1) select r.level, r.id, entity_ids, title, parent_id, coalesce(child_ids, '') as child_ids from rows r join titles t on t.level = r.level and t.community = r.id left join kids k on k.id = r.id and r.level = 1")
def s7_stored_communities(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    m, path = written(dealt(g), "dealt"), fresh_path(spark, "communities")
    stores.save_communities(stores.community_rows(m, communities.titles(g, m)), path)
    return stores.load_communities(spark, path).select("level", "id", F.array_join("entity_ids", "|").alias("entity_ids"), "title", "parent_id", F.array_join("child_ids", "|").alias("child_ids"))


@query(f"{G}, {DEALT}, {TITLES}, {ROWS} select r.level, r.id, title, num_entities, case when length(entity_ids) > 300 then entity_ids[:300] || '...' else entity_ids end as summary from rows r join titles t on t.level = r.level and t.community = r.id")
def q12_list_communities(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    m = written(dealt(g), "dealt")
    rows = stores.community_rows(m, communities.titles(g, m))
    return stores.list_communities(rows.withColumn("summary", F.array_join("entity_ids", "|"))).select("level", "id", "title", "num_entities", "summary")


@query(f"{G}, {DEALT}, {TITLES} select level, community, case when level = 1 then 'cached ' || title else 'new ' || title end as summary from titles")
def q7_summaries(spark, d):  # noqa: ANN001, ANN201
    """Summaries of all communities: cached ones are reused, the others come from the provider and are added to the cache."""
    g = stored_graph(spark, d)
    contexts = written(communities.titles(g, written(dealt(g), "dealt")).withColumn("context", F.col("title")), "titles")
    path = fresh_path(spark, "summary-cache")
    known = contexts.filter("level = 1").select(F.sha2("context", 256).alias("context_hash"), "community", F.concat(F.lit("cached "), "title").alias("summary"))
    stores.summary_upsert(known, path)
    said = communities.summaries(contexts, lambda c: F.concat(F.lit("SUMMARY: new "), c), spark.read.parquet(path))
    stores.summary_upsert(said, path)
    again = communities.summaries(contexts, lambda c: F.lit("not asked again"), spark.read.parquet(path))
    return again.select("level", "community", "summary")


@query(f"{G}, {DEALT}, {TITLES} select community, sha256(title) as fingerprint from titles where n % 2 = 0")
def k7_vector_index(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    said = communities.titles(g, written(dealt(g), "dealt")).withColumn("summary", F.when(F.col("n") % 2 == 0, F.col("title")).otherwise(""))
    path = fresh_path(spark, "index")
    for _ in range(2):  # built, then opened
        index = stores.open_index(spark, path, said, base.providers.embed)
    return index.select("community", "fingerprint")


# --- searches ----------------------------------------------------------------------------------
ADJ = "adj as (select src as x, dst as y from edges union select dst, src from edges), seeds as (select node_id from nodes where ord % 50 = 0), h1 as (select distinct s.node_id as seed, y as node_id from seeds s join adj on x = s.node_id where y <> s.node_id), h2 as (select distinct seed, y as node_id from h1 join adj on x = h1.node_id where y <> seed), hops as (select seed, node_id, min(hop) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) group by 1, 2), near as (select seed, node_id, hop from (select *, row_number() over (partition by seed order by hop, degree desc, ord) as r from hops join deg using (node_id) join nodes using (node_id)) where r <= 25)"


def _degrees(g: Graph) -> DataFrame:
    return written(degrees(g).join(g.nodes.select("node_id", "ord"), "node_id"), "degrees")


@query(f"{G} select node_id, row_number() over (order by degree desc, ord) as match_rank from deg join nodes using (node_id) order by degree desc, ord limit 12")
def l4_most_connected(spark, d):  # noqa: ANN001, ANN201
    return most_connected(_degrees(stored_graph(spark, d)), 12)


@query(f"{G}, {ADJ} select * from near")
def l6_nearest_neighbours(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    return nearest_neighbours(g.edges, g.nodes.filter("ord % 50 = 0"), _degrees(g), 25)


@query(f"{G}, {ADJ}, mixed as (select node_id, 1 as hit from seeds union all select node_id, 0 from near) select node_id, max(hit) as hit, any_value(degree) as degree from mixed join deg using (node_id) join nodes using (node_id) group by 1 order by hit desc, degree desc, any_value(ord) limit 25")
def l5_relevant_nodes(spark, d):  # noqa: ANN001, ANN201
    g = stored_graph(spark, d)
    deg, seeds = _degrees(g), g.nodes.filter("ord % 50 = 0")
    near = nearest_neighbours(g.edges, seeds, deg, 25)
    return relevant_nodes(seeds, near, deg, 25).select("node_id", "hit", "degree")


@query(
    f"""{G}, {DEALT}, {TITLES}, d as (select *, power(length(title) - length('{QUESTION}'), 2) + power(length(title) - length(replace(title, 'a', '')) - length('{QUESTION}') + length(replace('{QUESTION}', 'a', '')), 2) as distance from titles), hits as (select * from d order by distance, community limit 8)
 select 'global' as mode, string_agg('=== ' || title || ' (Level ' || level || ', ' || n || ' entities) ===' || chr(10) || title || chr(10), chr(10) order by distance, community) as context, sum(n)::bigint as total_nodes from hits"""
)
def a25_global_context(spark, d):  # noqa: ANN001, ANN201
    """Global search over titles, embedded by their length and how many letters a they have."""
    g = stored_graph(spark, d)
    m = written(dealt(g), "dealt")
    said = communities.titles(g, m).withColumn("summary", F.col("title"))
    embed = lambda c: F.array(F.length(c).cast("double"), F.regexp_count(c, F.lit("a")).cast("double"))
    index = written(said.withColumn("embedding", embed(F.col("summary"))), "titles")
    return global_search(Corpus(g, table(spark, d, "conversations"), m, said, index), QUESTION, embed=embed).select("mode", "context", "total_nodes")


@query(
    f"""{G}, {ADJ.replace("select node_id from nodes where ord % 50 = 0", "select node_id from deg join nodes using (node_id) order by degree desc, ord limit 12")}, mixed as (select node_id, 1 as hit from seeds union all select node_id, 0 from near),
 chosen as (select node_id, max(hit) as hit, any_value(degree) as degree from mixed join deg using (node_id) join nodes using (node_id) group by 1 order by hit desc, degree desc, any_value(ord) limit 25)
 select 'local' as mode, (select count(*) from chosen) as total_nodes, (select count(*) from und where a in (select node_id from chosen) and b in (select node_id from chosen)) as total_edges, (select string_agg(node_id, '|' order by degree desc, ord) from seeds join deg using (node_id) join nodes using (node_id)) as matched, 0::bigint as source_chunks_loaded"""
)
def q3_fallbacks(spark, d):  # noqa: ANN001, ANN201
    """Global search without an index, for a question that matches nothing: a local one from the nodes of the highest degree."""
    g = stored_graph(spark, d)
    m = written(dealt(g), "dealt")
    chunks = table(spark, d, "conversations").select(F.lit("none of the graph").alias("chunk_id"), "text")
    told = communities.titles(g, m).withColumn("summary", F.lit(""))
    x = global_search(Corpus(g, chunks, m, told, told.limit(0)), "Zzzqqq?")
    return x.select("mode", "total_nodes", "total_edges", F.array_join("matched_nodes", "|").alias("matched"), "source_chunks_loaded")


@query()
def q14_index_build(spark, d):  # noqa: ANN001, ANN201
    return corpus(spark, d).graph.nodes.drop("ord")


@query()
def q1_local_search(spark, d):  # noqa: ANN001, ANN201
    return local_search(corpus(spark, d), QUESTION)


@query()
def q2_global_search(spark, d):  # noqa: ANN001, ANN201
    return global_search(corpus(spark, d), QUESTION)


@query()
def q4_combined_search(spark, d):  # noqa: ANN001, ANN201
    """Over the stored index, opened again."""
    path = fresh_path(spark, "corpus")
    store(corpus(spark, d), path)
    return combined_search(load(spark, path), QUESTION)


# --- pages -------------------------------------------------------------------------------------
def _html() -> Column:
    p = lambda *xs: [x if isinstance(x, Column) else F.lit(x) for x in xs]
    name, brand, kind, size, key = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    para = p("<p>Brand <b>", brand, "</b> of size</p>")
    return F.concat(*p(
        "<html><head><title>", name, "</title></head><body class='page'><nav><p>a menu that is long enough</p></nav><div class='cookie-note'><p>we like to set cookies</p></div><main><h1>", name, "</h1>", *para, *para,
        "<ul><li>made of ", kind, " mostly</li><li>tiny</li></ul><table><tr><th>kind</th><th>size</th></tr><tr><td>", kind, "</td><td>", size, "</td></tr><tr><td>alone</td></tr></table>",
        "<dl><dt>What is it?</dt><dd>", kind, "</dd></dl><div class='faq-list'><div class='faq-question'>Why ", brand, "?</div><div class='faq-answer'>Because ", kind, " it is</div></div>",
        "<h2>Is it big?</h2><p>It is ", size, ".</p><p>Yes.</p><h5>no end</h5><p>Indeed.</p><h3>End</h3><p>Not this.</p></main>",
        "<a href='/a/", key, "/?x=1'>a</a><a href='http://other.net/x'>o</a><a href='http://shop.example/z#t'>z</a><a href='f.PDF'>f</a><a href='#top'>t</a><a href='mailto:x@shop.example'>m</a></body></html>",
    ))


def _url() -> Column:
    return F.concat(F.lit("http://www.shop.example/p/"), F.col("p_partkey").cast("string"))


def parts_as_pages(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The parts as pages, of which these fields are read."""
    return dealt_out(table(spark, sf_dir, "part")).select("p_partkey", page(_html(), _url(), fields=fields).alias("page"))


@query("select p_partkey, case when length(p_name) >= 15 then 'Section: ' || p_name || '|' else '' end || 'Brand' || p_brand || 'of size|Items: made of ' || p_type || ' mostly|Table data: Table columns: kind, size; kind: ' || p_type || ' | size: ' || p_size || '; alone|Definitions: What is it?: ' || p_type as chunks, p_name as title from part")
def p19_blocks(spark, d):  # noqa: ANN001, ANN201
    return parts_as_pages(spark, d, "title", "chunks").select("p_partkey", F.array_join("page.chunks", "|").alias("chunks"), "page.title")


@query("select p_partkey, 'Why ' || p_brand || '?' as question, 'Because ' || p_type || ' it is' as answer from part where length(p_type) + 14 > 20 union all select p_partkey, 'What is it?', p_type from part union all select p_partkey, 'Is it big?', 'It is ' || p_size || '. Yes. Indeed.' from part")
def p20_faqs(spark, d):  # noqa: ANN001, ANN201
    return parts_as_pages(spark, d, "faqs").select("p_partkey", F.inline("page.faqs"))


@query("select p_partkey, 'http://www.shop.example/a/' || p_partkey || ' http://shop.example/z http://www.shop.example/p/f.PDF' as links, 'http://www.shop.example/p/f.PDF' as documents from part")
def p21_links(spark, d):  # noqa: ANN001, ANN201
    return parts_as_pages(spark, d, "links", "documents").select("p_partkey", F.array_join("page.links", " ").alias("links"), F.array_join("page.documents", " ").alias("documents"))


MARKDOWN = """replace('# ' || p_name || '//Source: http://www.shop.example/p/' || p_partkey || '//# ' || p_name || '//Brand' || p_brand || 'of size/Brand' || p_brand || 'of size/- made of ' || p_type || ' mostly/- tiny/| kind /| size /| ' || p_type || ' /| ' || p_size || ' /| alone //## Is it big?//It is ' || p_size || './Yes./Indeed.//### End//Not this.', '/', chr(10))"""


@query(f"select p_partkey, replace({MARKDOWN}, 'http:' || chr(10) || chr(10) || 'www.shop.example' || chr(10) || 'p' || chr(10), 'http://www.shop.example/p/') as markdown from part")
def p24_markdown(spark, d):  # noqa: ANN001, ANN201
    return parts_as_pages(spark, d, "markdown").select("p_partkey", "page.markdown")


@query("select p_partkey, '{\"source\":\"u' || p_partkey || '\",\"category\":\"parts\",\"title\":\"' || p_name || '\",\"scraped_at\":\"now\",\"text_chunks\":[\"' || p_type || ' is the kind of it\"],\"faqs\":null}' as json from part")
def k8_page_json(spark, d):  # noqa: ANN001, ANN201
    html = F.concat(F.lit("<title>"), "p_name", F.lit("</title><p>"), "p_type", F.lit(" is the kind of it</p>"))
    x = dealt_out(table(spark, d, "part")).select("p_partkey", page(html, F.lit("http://e.org/"), fields=("title", "chunks", "faqs")).alias("page"))
    return x.select("p_partkey", stores.page_json(F.concat(F.lit("u"), F.col("p_partkey").cast("string")), F.lit("parts"), F.col("page"), F.lit("now")).alias("json"))


ENDINGS = ("", "/register", "/api/x", "/printers", "/print/", "/share", "/share/x", "/email/me", "/Login", "/cdn-cgi/l", "/a.pdf", "/b.DOCX?x", "/c.xlsm", "/search-it")
VARIED = "varied as (select page_id, regexp_replace(url, '[?#].*$', '') || [" + ", ".join(f"'{e}'" for e in ENDINGS) + f"][page_id % {len(ENDINGS)} + 1] as url from pages)"
SKIP = "regexp_matches(url, '/search|/login|/register|/logout|/api/|/cdn-cgi/|[?]|#|/print/|/share/|/email/')"
DOC = "regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '[.](pdf|doc|docx|xls|xlsx|ppt|pptx)$')"


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), ending).alias("url"))


@query(f"select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as normal, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) as key, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as authority, {SKIP} as skipped from pages")
def p15_urls(spark, d):  # noqa: ANN001, ANN201
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", normalize_url(u).alias("normal"), visit_key(u).alias("key"), authority(u).alias("authority"), excluded(u).alias("skipped"))


@query(f"with {VARIED} select page_id, {SKIP} as skipped, {DOC} as document, not {SKIP} and not {DOC} and (contains(lower(regexp_extract(url, '://([^/]*)', 1)), 'example.org') or contains('example.org', lower(regexp_extract(url, '://([^/]*)', 1)))) as visited from varied")
def f7_should_visit(spark, d):  # noqa: ANN001, ANN201
    u = F.col("url")
    return varied(spark, d).select("page_id", excluded(u).alias("skipped"), is_document(u).alias("document"), should_visit(u, F.lit("example.org")).alias("visited"))


@query("select p_partkey from part where p_size % 4 in (0, 3)")
def f8_html_responses(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "TEXT/HTML; charset=utf-8").when(k == 1, "application/pdf").when(k == 3, "text/html")
    return table(spark, d, "part").filter(is_page(kind)).select("p_partkey")


@query("select page_id, regexp_matches(regexp_replace(url || ext, '[?#].*$', ''), '(?i)\\.(pdf|docx?|xlsx?|pptx?)$') as document, a <> '' and (contains(a, 'example.org') or contains('example.org', a)) as inside from (select *, ['.PDF?x=1', '.docx', '.xlsm', '/'][page_id % 4 + 1] as ext, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as a from pages)")
def p22_document_links(spark, d):  # noqa: ANN001, ANN201
    ext = F.element_at(F.array(F.lit(".PDF?x=1"), F.lit(".docx"), F.lit(".xlsm"), F.lit("/")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", is_document(F.concat("url", ext)).alias("document"), same_site(F.col("url"), F.lit("example.org")).alias("inside"))


PATH = "trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/')"


@query(f"with n as (select page_id, url, regexp_replace(regexp_replace(case when {PATH} = '' then 'index' else {PATH} end, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g')[:100] as name from pages) select page_id, name || case r when 0 then '' else '_' || r end || '.json' as file from (select *, row_number() over (partition by name order by url) - 1 as r from n)")
def k8_page_files(spark, d):  # noqa: ANN001, ANN201
    return stores.page_files(table(spark, d, "pages").select("page_id", "url")).select("page_id", "file")


@query("with u as (select distinct regexp_replace(url, '[?#].*$', '') || case when page_id % 3 = 0 then '/report.pdf' else '/notes.v' || page_id % 5 || '.docx?x=1' end as url from pages order by 1 limit 100), n as (select url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as name from u), r as (select *, row_number() over (partition by name order by url) as r from n) select url, case when r = 1 then name else regexp_replace(name, '[.][^.]*$', '') || '_' || md5(url)[:8] || regexp_extract(name, '([.][^.]*)$', 1) end as file from r")
def s15_download_files(spark, d):  # noqa: ANN001, ANN201
    ending = F.when(F.col("page_id") % 3 == 0, "/report.pdf").otherwise(F.concat(F.lit("/notes.v"), (F.col("page_id") % 5).cast("string"), F.lit(".docx?x=1")))
    files = stores.download_files(table(spark, d, "pages").select(F.concat(F.regexp_replace("url", "[?#].*$", ""), ending).alias("url")))
    return stores.download(files, lambda u: u.encode(), fresh_path(spark, "downloads"))


@query("select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || chr(10) || 'SKIP to main  content' || chr(9) || role || ' back to Top share this page', '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(skip to main content|back to top)', '', 'gi'), ' ' || chr(10) || chr(9) || chr(13)) as cleaned from conversations")
def p17_clean_text(spark, d):  # noqa: ANN001, ANN201
    raw = F.concat("text", F.lit("\n \n\t\n\nSKIP to main  content\t"), "role", F.lit(" back to Top share this page"))
    return table(spark, d, "conversations").select("conv_id", "turn", clean_text(raw).alias("cleaned"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages numbered as parts, each with links to the two pages below it; some are no HTML, some say little."""
    k = F.col("p_partkey")
    link = lambda c: F.concat(F.lit("<a href='/w/"), c.cast("string"), F.lit("'>next</a>"))
    words = F.when(k % 5 == 0, "<p>short</p>").otherwise("<p>the first of three blocks</p><p>the second of three blocks</p><p>the third of three blocks</p>")
    faq = F.when(k % 3 == 0, "<h2>Is it so?</h2><p>Yes.</p>").otherwise("")
    html = F.concat(F.lit("<body><main>"), words, faq, F.lit("</main>"), link(2 * k), link(2 * k + 1), F.lit("<a href='/files/"), k.cast("string"), F.lit(".pdf'>f</a></body>"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("http://e.org/w/"), k.cast("string")).alias("url"), html.alias("html"), F.when(k % 7 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8").alias("content_type"))


REACHED = "recursive reached(k, depth) as (select 1, 0 union all select x, depth + 1 from (select k, depth, unnest([2 * k, 2 * k + 1]) as x from reached where depth < 4 and k % 7 <> 0)), got as (select * from reached where k % 7 <> 0 and k in (select p_partkey from part))"


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return crawl(spark, ["http://E.org/w/1/", "http://e.org/login", "http://o.net/w/1", "http://e.org/x.pdf"], web(spark, sf_dir), "e.org", max_depth=4)


@query(f"with {REACHED} select 'http://e.org/w/' || k as url, depth from got where k % 5 <> 0 or k % 3 = 0")
def t4_crawl(spark, d):  # noqa: ANN001, ANN201
    return _crawled(spark, d)[0].select("url", "depth")


@query(f"with {REACHED} select (select count(*) from got where k % 5 <> 0 or k % 3 = 0) as pages, (select count(*) from got) + 1 as documents, (select count(*) from got where k % 3 = 0) as faqs")
def a27_crawl_statistics(spark, d):  # noqa: ANN001, ANN201
    return crawl_statistics(*_crawled(spark, d))


LISTED = "listed as (select 'c' || p_partkey % 3 as category, 's' || p_partkey % 2 as subcategory, 'n' || p_partkey as name, case when p_partkey % 4 = 0 then 'exists' when p_partkey % 5 = 0 then 'failed' else 'saved' end as status from part)"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    catalogue = p.select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("subcategory"), F.concat(F.lit("n"), k.cast("string")).alias("name"), _url().alias("url"), k)
    return scrape_list(catalogue.drop("p_partkey"), p.filter(k % 5 != 0).select(_url().alias("url"), _html().alias("html")), catalogue.filter(k % 4 == 0))


@query(f"with {LISTED} select * from listed")
def s14_scrape_list(spark, d):  # noqa: ANN001, ANN201
    return _listed(spark, d).select("category", "subcategory", "name", "status")


@query(f"with {LISTED} select category, subcategory, count(*) as total, count(*) filter (status <> 'failed') as completed from listed group by 1, 2")
def a27_scrape_counts(spark, d):  # noqa: ANN001, ANN201
    return scrape_counts(_listed(spark, d))


@query("select url || '#' || page_id as url, case when page_id % 4 = 0 then null else 'got ' || url || '#' || page_id end as html from pages")
def t2_rate_limited_fetch(spark, d):  # noqa: ANN001, ANN201
    """A fetcher that knows from the address alone which pages are missing."""
    url = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    p = table(spark, d, "pages").select(url.alias("url"), authority(F.col("url")).alias("domain"))
    return rate_limited(p, lambda u: None if int(u.rpartition("#")[2]) % 4 == 0 else f"got {u}", delay=0.0)


# --- texts -------------------------------------------------------------------------------------
@query("select p_partkey, case p_partkey % 4 when 0 then 'Q: ' || p_name || chr(10) || 'A: ' || p_type || chr(10) || chr(10) || 'Q: q' || chr(10) || 'A: ' when 1 then p_name || chr(10) || chr(10) || p_brand when 2 then p_name || ' ' || p_type else p_name || chr(10) || chr(10) || p_size end as text from part")
def s3_json_text(spark, d):  # noqa: ANN001, ANN201
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    faq = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    shapes = (F.to_json(F.struct(F.array(faq(name, kind), faq(F.lit("q"), F.lit(""))).alias("faq_items"))), F.to_json(F.struct(F.array(name, brand).alias("text_chunks"))), F.to_json(F.struct(name.alias("a"), F.lit(5).alias("n"), kind.alias("b"))))
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).when(k == 2, shapes[2]).otherwise(F.concat(F.lit('["'), name, F.lit('", '), F.col("p_size").cast("string"), F.lit("]")))
    return table(spark, d, "part").select("p_partkey", json_document(raw).alias("text"))


@query("select n_name || chr(10) as text, 12 as id_length from nation union all select n_name || chr(10) || chr(10) || 'x', 12 from nation")
def s1_corpus_scan(spark, d):  # noqa: ANN001, ANN201
    """A folder of text, JSON and other files, some blank, read as documents: one file for each nation and kind."""
    n, path = table(spark, d, "nation"), fresh_path(spark, "corpus-files")
    n.select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/a")
    n.select(F.array("n_name", F.lit("x")).alias("text_chunks"), "n_nationkey").write.partitionBy("n_nationkey").json(f"{path}/b")
    n.select(F.lit("  ").alias("value")).coalesce(1).write.text(f"{path}/blank")
    n.coalesce(1).write.orc(f"{path}/other")
    return read_documents(spark, path).select("text", F.length("doc_id").alias("id_length"))


@query("select n_nationkey::varchar as id, 'What of ' || n_name || '?' as question, 'c' || n_regionkey as category, 'specific' as question_type, 'easy' as difficulty, n_name || ',x' as expected_entities, n_name as answer_keywords from nation where n_regionkey = 1")
def s16_question_set(spark, d):  # noqa: ANN001, ANN201
    """An evaluation file of the nations, written, read and filtered."""
    name, path = F.col("n_name"), fresh_path(spark, "questions")
    one = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("What of "), name, F.lit("?")).alias("question"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("category"), F.lit("specific").alias("question_type"), F.lit("easy").alias("difficulty"), F.array(name, F.lit("x")).alias("expected_entities"), F.array(name).alias("answer_keywords"), F.lit("").alias("reference_note"))
    table(spark, d, "nation").agg(F.to_json(F.struct(F.struct(F.lit("1.0").alias("version")).alias("metadata"), F.collect_list(one).alias("questions"))).alias("value")).write.text(path)
    q = filter_questions(read_questions(spark, path), category="c1")
    return q.select("id", "question", "category", "question_type", "difficulty", F.array_join("expected_entities", ",").alias("expected_entities"), F.array_join("answer_keywords", ",").alias("answer_keywords"))


@query("""select p_partkey, '{"name": "' || p_name || '", "type": "' || p_type || '"' || case when p_partkey % 2 = 0 then ', "list": ["x", {"y": 1}]' else '' end || '}' as json from part""")
def p4_repair(spark, d):  # noqa: ANN001, ANN201
    broken = F.concat(F.lit("{name: '"), "p_name", F.lit("', \t'type': '"), "p_type", F.when(F.col("p_partkey") % 2 == 0, "', \"list\": [\"x\", {y: 1,").otherwise("',"))
    return table(spark, d, "part").select("p_partkey", repaired_json(broken).alias("json"))


@query()
def p13_chunks(spark, d):  # noqa: ANN001, ANN201
    """Chunks of the recursive splitter over all documents; a plain version is in the tests."""
    return chunk_documents(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


@query(
    """with lines as (select p_partkey, i, lpad(i::varchar, 4, '0') || rpad(p_name, 46, 'x') as line from part, range(0, 100) t(i)),
 starts as (select p_partkey, unnest(range(0, 4)) as chunk_idx from part)
 select p_partkey || '_chunk_' || chunk_idx as chunk_id, p_partkey::varchar as doc_id, chunk_idx, string_agg(line, chr(10) order by i) as text from starts join lines using (p_partkey) where i between 26 * chunk_idx and 26 * chunk_idx + 28 group by all"""
)
def p13_line_chunks(spark, d):  # noqa: ANN001, ANN201
    """A hundred lines of 50 characters: 29 lines fill a chunk of 1500, three of them are repeated in the next."""
    line = lambda i: F.concat(F.lpad(i.cast("string"), 4, "0"), F.rpad("p_name", 46, "x"))
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), line), "\n").alias("text"))
    return chunk_documents(docs).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over w as before, row_number() over w as r from events window w as (partition by user_id order by ts, event_id)) where r = 1 or before is distinct from event_type")
def w5_consecutive_duplicates(spark, d):  # noqa: ANN001, ANN201
    return without_repeats(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("select doc_id, source, lower(text)[:50] as key from documents qualify row_number() over (partition by source, lower(text)[:50] order by doc_id) = 1")
def w6_first_occurrence(spark, d):  # noqa: ANN001, ANN201
    x = first_of_each(table(spark, d, "documents").select("doc_id", "source", "text"), ["source"], question_key(F.col("text")), "doc_id")
    return x.select("doc_id", "source", question_key(F.col("text")).alias("key"))


# --- stores ------------------------------------------------------------------------------------
@query(f"{G} select node_id, name, type, description, source_chunk, (select count(*) from edges) as edges from nodes")
def s6_graph_store(spark, d):  # noqa: ANN001, ANN201
    path = fresh_path(spark, "graph")
    stores.save_graph(graph(spark, d), path)
    g = stores.load_graph(spark, path)
    return g.nodes.join(g.edges.agg(F.count("*").alias("edges")), how="cross").drop("ord")  # one row


@query(f"with {ENT}, e as (select count(*) as entities from (select distinct {NORM.format('name')}, lower(type) from ent)), r as (select count(*) as relationships from (select distinct {NORM.format('source')}, {NORM.format('target')}, lower(relation_type) from rel)) select * from e, r")
def k6_merged_extractions(spark, d):  # noqa: ANN001, ANN201
    path = fresh_path(spark, "merged")
    stores.save_extractions(merge_entities(base.entities(spark, d)), merge_relationships(base.relations(spark, d)), path)
    e, r = stores.load_extractions(spark, path)
    return e.agg(F.count("*").alias("entities")).join(r.agg(F.count("*").alias("relationships")), how="cross")  # one row each


@query("with e as (select 'c' || p_partkey as source_chunk, p_brand as name, case when p_size % 3 = 0 then 'Concept' else p_type end as type from part union all select 'c' || p_partkey, p_name, 'Concept' from part) select count(*) as rows, (select count(*) from (select distinct lower(trim(name)), lower(type) from e)) as merged, (select count(*) from part) as relations from e")
def a3_merge_counts(spark, d):  # noqa: ANN001, ANN201
    parsed = answers(spark, d)
    place = lambda rows: rows.withColumn("ord", F.struct("source_chunk", "item"))
    e = place(entity_rows(parsed))
    one = e.agg(F.count("*").alias("rows")).join(merge_entities(e).agg(F.count("*").alias("merged")), how="cross")
    return one.join(relationship_rows(parsed).agg(F.count("*").alias("relations")), how="cross")  # one row each


@query("select text as content, min(case when turn % 3 = 1 then 'ok' else 'failed' end) filter (turn % 3 < 2) as status from conversations where turn % 3 < 2 group by 1 having count(*) filter (turn % 3 = 1) = 0 union all select distinct text, 'ok' from conversations where turn % 3 = 1")
def k4_cache_upsert(spark, d):  # noqa: ANN001, ANN201
    """Failures first, then successes twice: each text has one row of the best status it got."""
    c = table(spark, d, "conversations").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), "turn")
    path = fresh_path(spark, "cache")
    row = lambda r, status: c.filter(F.col("turn") % 3 == r).select("content_hash", "content", F.lit(status).alias("status"))
    for rows in (row(0, "failed"), row(1, "ok"), row(1, "ok"), row(0, "failed")):
        stores.cache_upsert(rows, path)
    held = spark.read.parquet(path)
    return held.groupBy("content").agg(F.max("status").alias("status"))


@query("select count(*) as chunks, count(*) filter (text in (select text from conversations where turn = 1)) as cached, count(*) filter (text not in (select text from conversations where turn = 1)) as generated, 0 as failed from conversations where text is not null")
def a19_extraction_counts(spark, d):  # noqa: ANN001, ANN201
    chunks = table(spark, d, "conversations").filter("text is not null").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text", "turn")
    cache = written(extractions(chunks.filter("turn = 1")), "extraction-cache")
    return extraction_counts(extractions(chunks, cache=cache)).select("chunks", "cached", "generated", "failed")


@query("with c as (select text, turn % 3 = 0 as failed from conversations where text is not null) select count(*) as chunks, count(*) filter (text in (select text from c where not failed)) as cached, count(*) filter (text not in (select text from c where not failed)) as generated from c")
def t6_retry(spark, d):  # noqa: ANN001, ANN201
    """Chunks whose extraction failed go from the cache, and the next run extracts them again."""
    chunks = table(spark, d, "conversations").filter("text is not null").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text", "turn")
    cache = written(extractions(chunks), "extraction-cache")
    left = written(stores.cache_delete(cache, chunks.filter("turn % 3 = 0")), "extraction-cache")
    return extraction_counts(extractions(chunks, cache=left)).select("chunks", "cached", "generated")


@query(f"with {RES} select dimension, value, count(*) as n, round(avg(recall) filter (success), 9) as recall_mean from (select 'category' as dimension, category as value, * from res union all select 'difficulty', difficulty, * from res union all select 'question_type', question_type, * from res) group by 1, 2 having count(*) filter (success) > 0")
def k9_report(spark, d):  # noqa: ANN001, ANN201
    r, path = base.results(spark, d), fresh_path(spark, "report")
    stores.report(evaluation.aggregate(r), evaluation.breakdowns(r), r.limit(10), path)
    return spark.read.json(f"{path}/breakdowns").select("dimension", "value", "n", F.round("recall_mean", 9).alias("recall_mean"))


# --- evaluation --------------------------------------------------------------------------------
@query("with p as (select p_partkey, list_distinct(string_split(lower(trim(p_type)), ' ')) as w, lower(trim(p_type)) as t from part) select p_partkey, (len(list_intersect(w, ['standard', 'polished', 'x'])) >= least(2, len(w)) or contains('standard polished x', t) or contains(t, 'standard polished x') or len(list_intersect(w, ['promo', 'brass'])) >= least(2, len(w)) or contains('promo brass', t) or contains(t, 'promo brass'))::int::double as recall from p")
def j13_entity_overlap(spark, d):  # noqa: ANN001, ANN201
    x = evaluation.entity_overlap(F.array(F.col("p_type")), F.array(F.lit("Standard_Polished-x"), F.lit("promo BRASS")))
    return table(spark, d, "part").select("p_partkey", x["recall"].alias("recall"))


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, answers) of the parts; every fifth question fails, every seventh has no answer."""
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    p = table(spark, sf_dir, "part").withColumn("id", k.cast("string"))
    questions = p.select("id", F.col("p_name").alias("question"), F.col("p_type").alias("category"), F.lit("t").alias("question_type"), F.lit("d").alias("difficulty"), F.array("p_brand", F.lit("zzz qqq")).alias("expected_entities"), F.array("p_type", F.lit("zz qq")).alias("answer_keywords"))
    nodes = F.when(k % 3 == 0, F.array(brand)).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(brand, F.lit("other")))
    told = p.filter(k % 7 != 0).select("id", F.concat(F.lit("It is "), F.lower("p_type")).alias("answer"), F.lit("local").alias("resolved_mode"), nodes.alias("matched_entities"), nodes.alias("matched_nodes"), (k % 4).cast("long").alias("source_chunks_loaded"), F.lit(5.0).alias("latency_ms"), F.when(k % 5 == 0, "no model").alias("error"))
    return questions, told


EVALUATED = "e as (select p_partkey as k, p_type, p_partkey % 5 <> 0 and p_partkey % 7 <> 0 as success, case p_partkey % 3 when 0 then 1.0 when 1 then 0.0 else 0.5 end as p, case p_partkey % 3 when 1 then 0.0 else 0.5 end as r from part)"


@query(f"with {EVALUATED} select k::varchar as id, success, case when success then p else 0 end::double as precision, case when success then r else 0 end::double as recall, case when success and p + r > 0 then 2 * p * r / (p + r) else 0 end::double as f1, case when success then 0.5 else 0 end::double as coverage, case when success then 'zz qq' else p_type || '|zz qq' end as missing, case when success then length(p_type) + 6 else 0 end as answer_length, case when k % 7 = 0 then 'error' else 'local' end as resolved_mode from e")
def q15_evaluate(spark, d):  # noqa: ANN001, ANN201
    x = evaluate.evaluate(*asked(spark, d))
    return x.select("id", "success", "precision", "recall", "f1", "coverage", F.array_join("keywords_missing", "|").alias("missing"), "answer_length", "resolved_mode")


@query(f"with {EVALUATED} select k::varchar as id, case when success and k % 11 <> 0 then 5 end as relevance, case when success and k % 11 <> 0 then 2 end as accuracy, case when success and k % 11 <> 0 then 1 end as coherence, case when success and k % 11 <> 0 then 2.25 end::double as overall, success and k % 11 = 0 as unread from e")
def q16_judge(spark, d):  # noqa: ANN001, ANN201
    said = lambda ask: F.when(F.contains(ask, F.lit("unread")), "no verdict").otherwise('<think>x</think>{"relevance": {"score": 7}, "accuracy": {"score": 2.5}, "completeness": 1}')
    results = evaluate.evaluate(*asked(spark, d)).withColumn("question", F.when(F.col("id").cast("int") % 11 == 0, "unread").otherwise("q"))
    x = evaluate.judge(results, said)
    return x.select("id", "relevance", "accuracy", "coherence", "overall", F.col("judge_error").isNotNull().alias("unread"))


@query("select p_partkey, (p_size % 6)::double as relevance, 2.0::double as coherence, null::double as completeness, p_size % 5 = 0 as failed from part where p_size % 5 <> 0 union all select p_partkey, null, null, null, true from part where p_size % 5 = 0")
def p6_judge_answers(spark, d):  # noqa: ANN001, ANN201
    said = F.concat(F.lit('```json\n{"relevance": '), (F.col("p_size") % 6).cast("string"), F.lit(', "coherence": {"score": "2"}}\n```'))
    x = table(spark, d, "part").select("p_partkey", verdict(F.when(F.col("p_size") % 5 == 0, F.lit("no verdict")).otherwise(said)).alias("x"))
    return x.select("p_partkey", "x.relevance", "x.coherence", "x.completeness", F.col("x.error").isNotNull().alias("failed"))


@query("with v as (select case when event_id % 3 = 0 then event_id % 4 + 1.5 end as overall, event_id % 5 as relevance, event_id % 7 as accuracy, case when event_id % 2 = 0 then 4 end as completeness, event_id % 3 as coherence from events) select count(*) as judged, round(avg(overall), 9) as overall_mean, median(overall::double) as overall_median, round(avg(relevance), 9) as relevance_mean, round(avg(accuracy), 9) as accuracy_mean, round(avg(completeness), 9) as completeness_mean, round(avg(coherence), 9) as coherence_mean from v where overall is not null")
def a21_judge_summary(spark, d):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    v = table(spark, d, "events").select(F.when(i % 3 == 0, i % 4 + 1.5).cast("double").alias("overall"), (i % 5).alias("relevance"), (i % 7).alias("accuracy"), F.when(i % 2 == 0, 4).alias("completeness"), (i % 3).alias("coherence"))
    out = evaluation.judge_summary(v)
    return out.select("judged", "overall_median", *[F.round(c, 9).alias(c) for c in out.columns if c.endswith("_mean")])


# --- streams -----------------------------------------------------------------------------------
@query("select conv_id::varchar as session_id, turn, coalesce(string_agg(case role when 'user' then 'User: ' else 'Assistant: ' end || coalesce(text, ''), chr(10)) over (partition by conv_id order by turn rows between 10 preceding and 1 preceding), '(No previous conversation)') as history from conversations")
def t1_running_history(spark, d):  # noqa: ANN001, ANN201
    """A stream of messages with keyed state, read to its end."""
    src, out, at = (fresh_path(spark, x) for x in ("messages", "told", "told-checkpoint"))
    m = messages(spark, d)
    m.write.parquet(src)
    told = running_history(spark.readStream.schema(m.schema).parquet(src))
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


@query("select text, count(*) as n from (select distinct text from conversations) group by 1")
def t3_incremental_extraction(spark, d):  # noqa: ANN001, ANN201
    """Two runs of a stream over a growing folder: each text is extracted once."""
    src, cache, at = (fresh_path(spark, x) for x in ("stream-chunks", "stream-cache", "stream-checkpoint"))
    chunks = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text", "turn")
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        chunks.filter(part).drop("turn").write.mode("append").parquet(src)
        stream = spark.readStream.schema("chunk_id string, text string").parquet(src)
        incremental_extraction(stream, lambda df: df.select("content_hash", "text", F.lit("ok").alias("status")), cache, at).awaitTermination()
    return spark.read.parquet(cache).groupBy("text").agg(F.count("*").alias("n"))
