import json
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import evaluation, quantiles
from loomspark.plans import chat, index_build, search
from loomspark.sources import corpus, store
from loomspark.streaming import sessions

TEXT = "Alpha Board runs the Beta Scheme. The Beta Scheme pays Gamma Grant. Gamma Grant helps Delta Home. Alpha Board met Delta Home."


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "x.TXT").write_text("endings are case-sensitive")
    (tmp_path / "sub/B.json").write_text(json.dumps({"faq_items": [{"question": "q", "answer": "a"}]}))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.md").write_text("  \n")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    docs = corpus.read_documents(spark, str(tmp_path)).orderBy("doc_ord").collect()
    assert [r.source_path.rsplit("/", 1)[1] for r in docs] == ["a.txt", "c.csv", "B.json"]
    assert docs[2].text == "Q: q\nA: a" and len(docs[0].doc_id) == 12
    assert corpus.json_text('{"text_chunks": ["a", "b"], "faqs": null}') == "a\n\nb" and corpus.json_text("[1, 2]") == "1\n\n2" and corpus.json_text("{") == ""
    maps = spark.createDataFrame([("i", "<sitemapindex><loc>m</loc></sitemapindex>"), ("m", "<urlset><loc> u1 </loc><loc>u2</loc></urlset>")], "url string, xml string")
    assert {tuple(r) for r in corpus.read_sitemaps(maps).collect()} == {("i", "u1"), ("i", "u2")}
    index = lambda *xs: "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in xs) + "</sitemapindex>"
    page = lambda x: f"<urlset><loc>{x}</loc></urlset>"
    nested = [("top", index("a", "missing", "mid", "cut")), ("a", page("pa")), ("mid", index("in", "mid", "x1", "x2")), ("in", index("deep")), ("deep", page("pd")), ("x1", page("p1")), ("x2", page("p2")), ("own", page("po")), ("none", None)]
    got = {tuple(r) for r in corpus.read_sitemaps(spark.createDataFrame(nested, "url string, xml string"), max_children=3).collect()}
    assert got == {("top", "pa"), ("top", "pd"), ("top", "p1"), ("x2", "p2"), ("own", "po")}


def test_index_and_search(spark):
    c = index_build.build(spark.createDataFrame([("d1", TEXT), ("d2", TEXT.replace("Delta", "Omega"))], "doc_id string, text string"))
    assert {r.node_id for r in c.graph.nodes.collect()} >= {"alpha board", "beta scheme", "gamma grant"}
    r = search.local_search(c, "What does Beta-Scheme pay?").first()
    assert "=== SOURCE DOCUMENTS ===" in r.context and "=== ENTITIES ===" in r.context and r.total_nodes > 0
    assert search.search(c, "anything else zzz", "combined").first().mode == "combined"
    empty = spark.createDataFrame([], "session_id string, turn long, role string, content string")
    after, _ = chat.ask(spark, c, empty, "s", "Beta Scheme?", "local")
    assert [x.role for x in after.orderBy("turn").collect()] == ["user", "assistant"]
    assert chat.visible(chat.clear(after, "s")).count() == 0


def test_history(spark):
    m = spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(13)], "session_id string, turn long, role string, content string")
    lines = chat.history(m).first().history.split("\n")
    assert len(lines) == 10 and lines[0] == "User: m2" and lines[-1] == "Assistant: m11"


def test_evaluation(spark):
    df = spark.createDataFrame([(["cpf_contribution", "employee"], ["CPF Contribution rate", "x"], "20% for the employer", ["20%", "employer the", "zz"])], "e array<string>, r array<string>, a string, k array<string>")
    x = df.select(evaluation.entity_overlap(F.col("e"), F.col("r")).alias("o"), evaluation.keyword_coverage(F.col("a"), F.col("k")).alias("c")).first()
    assert (x.o.matched, x.o.precision, x.o.recall) == (1, 0.5, 0.5) and abs(x.c - 2 / 3) < 1e-9
    for n in (0, 1, 20, 21, 100):
        want = float(sorted(range(n))[min(int(0.95 * n), n - 1)]) if n else None
        assert quantiles.exact_quantiles(spark.range(n), {"p": ("id", "p95")}) == {"p": want}


def test_exact_quantiles_of_skewed_values(spark):
    """Many equal values, huge and tiny ones, nulls and NaN: the same as sorting."""
    r = random.Random(6)
    values = [3.0] * 400 + [r.lognormvariate(0, 30) * r.choice((-1, 1)) for _ in range(301)] + [1e308, -1e308, 1e-300, math.nan, None]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, w int")
    real = sorted(v for v in values if v is not None and v == v)
    got = quantiles.exact_quantiles(df, {"m": ("v", "median"), "p": ("v", "p95"), "w": ("w", "median")})
    assert got == {"m": statistics.median(real), "p": real[int(0.95 * len(real))], "w": statistics.median(i % 7 for i in range(len(values)))}


def test_caches(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "t1"), ("c2", "t2")], "chunk_id string, text string")
    first = index_build.extractions(chunks)
    path = str(tmp_path / "cache")
    store.cache_append(first.filter("chunk_id = 'c1'"), path)
    hits, misses = store.cache_lookup(chunks, spark.read.parquet(path), "rules-1")
    assert [r.chunk_id for r in hits.collect()] == ["c1"] and [r.chunk_id for r in misses.collect()] == ["c2"]
    assert corpus.empty_extractions(first).count() == 2
    assert store.cache_delete(first, chunks.filter("chunk_id = 'c1'")).count() == 1


def test_streaming_history(spark, tmp_path):
    rows = [("s", i, "user", f"m{i}") for i in range(4)]
    spark.createDataFrame(rows, "session_id string, turn long, role string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, turn long, role string, content string").parquet(str(tmp_path / "in"))
    q = sessions.running_history(stream, 2).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.turn: r.history for r in spark.table("told").collect()}
    assert got[0] == "(No previous conversation)" and got[3] == "User: m1\nUser: m2"


def test_history_of_late_repeated_and_cleared_messages():
    """The state step itself: order by turn, repeats, clear events, expiry."""

    class State:
        def __init__(self):
            self.value, self.hasTimedOut, self.timeout = None, False, None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        update = lambda self, v: setattr(self, "value", v)
        remove = lambda self: setattr(self, "value", None)
        setTimeoutDuration = lambda self, ms: setattr(self, "timeout", ms)  # noqa: E731, N815

    held = {}

    class Messages:
        filter = groupBy = lambda self, _: self
        applyInPandasWithState = lambda self, step, *_: held.update(step=step)  # noqa: E731, N815

    sessions.running_history(Messages(), 2, idle_ms=5)
    state = State()
    say = lambda *rows: [tuple(r)[1:] for p in held["step"](("s",), iter([pd.DataFrame(rows, columns=["session_id", "turn", "role", "content"])]), state) for r in p.itertuples(index=False)]
    m = lambda t: ("s", t, "user", f"m{t}")
    none = "(No previous conversation)"
    assert say(m(5), m(1)) == [(1, none), (5, "User: m1")]
    assert say(m(3), m(5), m(3)) == [(3, "User: m1")] and state.timeout == 5
    assert say(m(6)) == [(6, "User: m3\nUser: m5")]
    assert say(("s", 6, "cleared", ""), m(6), m(7)) == [(7, none)]
    assert say(m(2), m(8)) == [(8, "User: m7")]
    state.hasTimedOut = True
    assert say() == [] and state.value is None


def test_incremental_extraction(spark, tmp_path):
    src, cache = str(tmp_path / "chunks"), str(tmp_path / "cache")
    schema = "chunk_id string, text string"

    def run():
        q = sessions.incremental_extraction(spark.readStream.schema(schema).parquet(src), lambda df: df.select("content_hash", F.lit("ok").alias("status")), cache, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return spark.read.parquet(cache).count()

    spark.createDataFrame([("c1", "t1"), ("c2", "t1")], schema).write.parquet(src)
    assert run() == 1
    spark.createDataFrame([("c3", "t1"), ("c4", "t2")], schema).write.mode("append").parquet(src)
    assert run() == 2


def test_crawl(spark):
    page = lambda links: "<body>" + "".join(f"<p>paragraph number {i} of it</p>" for i in range(3)) + "".join(f'<a href="{x}">x</a>' for x in links) + "</body>"
    pages = spark.createDataFrame([("http://e.org/a", page(["/b", "/c", "/x.pdf", "http://o.net/z"])), ("http://e.org/b", page(["/a", "/d"])), ("http://e.org/c", "<body></body>"), ("http://e.org/d", page(["/e"])), ("http://e.org/e", page([]))], "url string, html string")
    kept, documents = sessions.crawl(spark, ["http://E.org/a/"], pages, "e.org", max_depth=2)
    assert {(r.url[-1], r.depth) for r in kept.collect()} == {("a", 0), ("b", 1), ("d", 2)}
    assert [r[0] for r in documents.collect()] == ["http://e.org/x.pdf"]


def test_graph_store(spark, tmp_path):
    from tests.test_graph import path

    store.save_graph(path(spark), str(tmp_path / "graph"))
    assert store.load_graph(spark, str(tmp_path / "graph")).edges.count() == 3
    assert store.clean(spark, str(tmp_path)) == ["graph"]


def plain_split(text, size=1500, overlap=200, separators=("\n\n", "\n", " ", "")):
    """The recursive splitter by its definition: pieces that keep the separator before them, merged greedily."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        first, *rest = text.split(sep)
        pieces = [p for p in [first, *(sep + r for r in rest)] if p]
    else:
        pieces = list(text)
    out, good = [], []

    def merge():
        window, total = [], 0
        for p in good:
            if total + len(p) > size and window:
                out.append("".join(window).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if window:
            out.append("".join(window).strip())
        good.clear()

    for p in pieces:
        if len(p) <= size:
            good.append(p)
        else:
            merge()
            out.extend(plain_split(p, size, overlap, finer) if finer else [p])
    merge()
    return [x for x in out if x]


def test_splitter_on_documents(spark):
    from loomspark.plans import catalog, catalog_more  # noqa: F401

    d = "/root/testdata/sf0.001"
    want = {f"{r.doc_id}_chunk_{i}": x for r in spark.read.parquet(f"{d}/documents.parquet").collect() for i, x in enumerate(plain_split(r.text or ""))}
    assert {r.chunk_id: r.text for r in catalog.QUERIES["p13_chunks"](spark, d).collect()} == want


def test_answers_are_timed_and_judged(spark):
    from loomspark.plans import evaluate

    c = index_build.build(spark.createDataFrame([("d1", TEXT)], "doc_id string, text string"))
    q = spark.createDataFrame([("q1", "What does Beta-Scheme pay?", "c", "t", "easy", ["beta_scheme"], ["Gamma"]), ("q2", "x", "c", "t", "easy", [], [])], "id string, question string, category string, question_type string, difficulty string, expected_entities array<string>, answer_keywords array<string>")
    told = evaluate.answer_all(c, q, "local")
    got = {r.id: r for r in evaluate.judge(evaluate.evaluate(q, told)).collect()}
    assert got["q1"].success and got["q1"].recall == 1.0 and got["q1"].coverage == 1.0 and got["q1"].latency_ms > 0 and got["q1"].overall is None
    failed = evaluate.answer_all(c, q, "no such mode")
    assert [r.success for r in evaluate.evaluate(q, failed).collect()] == [False, False]


def test_stored_corpus(spark, tmp_path):
    c = index_build.build(spark.createDataFrame([("d1", TEXT)], "doc_id string, text string"))
    index_build.store(c, str(tmp_path / "corpus"))
    again = index_build.load(spark, str(tmp_path / "corpus"))
    assert search.local_search(again, "Beta-Scheme?").first().context == search.local_search(c, "Beta-Scheme?").first().context


def test_intermediate_tables_can_be_released(spark):
    from loomspark import storage

    spark2 = spark.newSession()
    df = storage.written(spark2.range(3), "kept")
    assert df.count() == 3 and storage._own_dir(spark).endswith(spark.sparkContext.applicationId)


def test_caches_of_a_build(spark, tmp_path):
    """Providers are asked once for each content; failures stay out of the summary cache and are named by members."""
    docs = spark.createDataFrame([("d1", TEXT), ("d2", TEXT.replace("Delta", "Omega"))], "doc_id string, text string")
    caches = str(tmp_path / "caches")
    silent = lambda c: F.lit(None).cast("string")
    first = index_build.build_all(docs, summarise=silent, caches=caches)
    lost = first.corpus.summaries.collect()
    assert lost and all(r.summary.startswith("Community containing: ") and len(r.summary.split(", ")) <= 5 for r in lost)
    again = index_build.build_all(docs, summarise=lambda c: F.concat(F.lit("<think>x</think>SUMMARY: told "), F.left(c, F.lit(9))), caches=caches)
    assert again.counts.first().asDict() | {"entities": 0, "relationships": 0} == {"chunks": 2, "cached": 2, "generated": 0, "failed": 0, "entities": 0, "relationships": 0, "summaries_cached": 0, "summaries": len(lost)}
    assert {r.summary for r in again.corpus.summaries.collect()} == {"told Community"}
    third = index_build.build_all(docs, summarise=silent, embed=lambda c: F.lit(None).cast("array<float>"), caches=caches)
    assert third.counts.first().summaries_cached == len(lost)
    assert all(r.embedding for r in third.corpus.index.collect())


def test_an_update_reads_changed_documents_only(spark, tmp_path):
    texts = {f"d{i}": TEXT.replace("Beta", f"Beta{i % 3}") for i in range(6)}
    frame = lambda x: spark.createDataFrame(list(x.items()), "doc_id string, text string")
    caches = str(tmp_path / "caches")
    built = index_build.build_all(frame(texts), caches=caches)
    later = {k: v for k, v in texts.items() if k != "d5"} | {"d0": "Alpha Board left. New Board came.", "d9": "New Board met Alpha Board."}
    new = index_build.update(built, frame(later), caches)
    assert new.counts.first().chunks == 2  # d0 and d9
    full = index_build.build_all(frame(later))
    for name in ("nodes", "edges", "entity_map"):
        a, b = getattr(new.state, name), getattr(full.state, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    same = index_build.update(new, frame(later), caches)
    assert same.counts.first().chunks == 0 and same.state.nodes.count() == full.state.nodes.count()
    assert index_build.update(same, frame(later).limit(0), caches).state.nodes.count() == 0


def test_failed_extractions_are_cached_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("h1", "failed"), ("h1", "failed"), ("h2", "ok"), ("h2", "failed")], "content_hash string, status string")
    for _ in range(2):
        store.cache_upsert(rows, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("h1", "failed"), ("h2", "ok")]
    store.cache_upsert(rows.limit(1).withColumn("status", F.lit("ok")), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("h1", "failed"), ("h1", "ok"), ("h2", "ok")]


def test_models_get_prompts(spark):
    from loomspark.plans import providers

    echo = lambda asked: F.concat(F.lit("<think>no</think>"), asked)
    row = spark.range(1).select(providers.model_extract(echo, ("A", "B"))(F.lit("the text")).alias("e"), providers.model_summarise(echo)(F.lit("ctx")).alias("s"), providers.model_terms(echo)(F.lit("why?")).alias("t")).first()
    assert "A, B" in row.e and row.e.endswith("the text") and row.s.endswith("ctx") and "<think>" not in row.s and row.t.endswith("why?")


def test_question_tables(spark):
    """A table of questions gives what single searches give, in every mode; no questions give no rows; a search that fails has an error each."""
    c = index_build.build(spark.createDataFrame([("d1", TEXT), ("d2", TEXT.replace("Delta", "Omega"))], "doc_id string, text string"))
    asked = {"a": "What does Beta-Scheme pay?", "b": "zzz", "c": None, "d": "Gamma Grant or Omega Home?"}
    q = spark.createDataFrame(list(asked.items()), "question_id string, question string")
    for mode in ("local", "global", "combined"):
        rows = {r.question_id: r for r in search.searches(c, q, mode).collect()}
        assert rows.keys() == asked.keys()
        for k in ("a", "d"):
            assert tuple(rows[k])[1:] == tuple(search.search(c, asked[k], mode).first())
    assert search.searches(c, q.limit(0)).count() == 0


def test_pages_of_a_small_table_go_to_many_tasks(spark, tmp_path):
    """A file of short rows is one task's; the pages made of them are read by more, scraped ones too."""
    from loomspark.plans import catalog, catalog_more  # noqa: F401

    source = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    source.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("p19_blocks", "p20_faqs", "p21_links", "p24_markdown", "k8_page_json", "s14_scrape_list"):
        x = catalog.QUERIES[name](spark, str(tmp_path))
        assert x.select(F.spark_partition_id().alias("p")).distinct().count() > 1, name


def test_pages_come_in_small_batches(spark):
    from loomspark.functions.html import page

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size, "10000")
    try:
        spark.conf.set(size, "10000")
        page("html", "url")
        assert int(spark.conf.get(size)) <= 1000
    finally:
        spark.conf.set(size, was)


def test_an_embedding_reads_its_text_once(spark):
    from loomspark.plans import providers

    texts = [("one two two Three",), ("",), (None,), ("x " * 300 + "y",)]
    x = spark.createDataFrame(texts, "text string").select("text", providers.embed(F.col("text")).alias("v"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    words = x.select("text", F.explode(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")).alias("w"))
    counts = words.groupBy("text", F.pmod(F.xxhash64("w"), F.lit(providers.DIMENSIONS)).alias("b")).count().collect()
    for r in x.filter("text is not null").collect():
        plain = [0.0] * providers.DIMENSIONS
        for c in counts:
            if c.text == r.text:
                plain[c.b] = c["count"]
        norm = max(sum(c * c for c in plain) ** 0.5, 1e-9)
        assert r.v == pytest.approx([c / norm for c in plain], abs=1e-6)


def test_page_files_of_equal_urls_have_an_order(spark):
    pages = spark.createDataFrame([("http://a/x", i) for i in (5, 3, 9, 1, 7)], "url string, page_id long")
    assert {r.page_id: r.file for r in store.page_files(pages).collect()} == {1: "x.json", 3: "x_1.json", 5: "x_2.json", 7: "x_3.json", 9: "x_4.json"}
