from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import answers, html, text, url


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names(spark):
    assert one(spark, text.normalize_name(F.lit("  CPF_Life-x "))) == "cpf life x"
    assert one(spark, text.normalize_name(text.normalize_name(F.lit("A_b-C")))) == "a b c"


def test_reasoning(spark):
    c = F.lit("<think>a\nb</think> answer <think>c</think>")
    assert one(spark, text.strip_think(c)) == "answer"
    assert tuple(one(spark, text.split_reasoning(c))) == ("a\nb", "answer")
    assert tuple(one(spark, text.split_reasoning(F.lit("<think>open")))) == (None, "<think>open")


def test_scores(spark):
    assert [one(spark, text.clamp_score(F.lit(x))) for x in (2.5, 3.5, 0.0, 9.0)] == [2, 4, 1, 5]
    assert one(spark, text.clamp_score(F.lit(None).cast("double"))) == 1
    assert one(spark, text.overall_score(F.lit(4), F.lit(None).cast("int"), F.lit(5))) == 4.5


def test_entity_lines(spark):
    assert one(spark, text.entity_lines(F.lit("- a b\n* cd\n• ef\n1. gh\n4. ij\nx"))) == ["a b", "cd", "ef", "gh", "4. ij"]


@given(st.text(alphabet="ab \n", max_size=400))
def test_splitter_bounds(s):
    parts = text.split_text(s, 40, 8)
    assert all(0 < len(p) <= 40 for p in parts)
    assert set("".join(parts)) - set(" \n") == set(s) - set(" \n")


def test_splitter_overlap():
    parts = text.split_text(" ".join(f"w{i}" for i in range(100)), 50, 20)
    assert all(len(p) <= 50 for p in parts)
    assert parts[0].split()[-1] in parts[1].split()


def test_answers():
    ok = answers.parse_extraction('<think>x</think>```json\n{"entities":[{"name":"A"}],"relationships":[]}\n```')
    assert ok["entities"][0]["name"] == "A" and ok["status"] == "ok"
    mended = answers.parse_extraction("{'entities': [{name: 'A', type: 'T',}], 'relationships': [],}")
    assert mended["entities"][0] == {"name": "A", "type": "T", "description": None} and mended["status"] == "repaired"
    cut = answers.parse_extraction('{"entities":[{"name":"A"},{"name":"B"}],"relationships":[{"source":"A"')
    assert [e["name"] for e in cut["entities"]] == ["A", "B"]
    nested = answers.parse_extraction('{"entities": [{"name": "A ] b", "attributes": {"k": [1]}}, {"name": "B"}, oops ], "relationships": [{"source": "A", "x": {"y": 1}, "target": "B"} {')
    assert [e["name"] for e in nested["entities"]] == ["A ] b", "B"] and nested["relationships"][0]["target"] == "B" and nested["status"] == "partial"
    assert answers.parse_extraction("no json") == {"entities": [], "relationships": [], "status": "failed"}
    assert answers.parse_extraction(None)["status"] == "failed"
    assert answers.parse_verdict('{"relevance":{"score":7},"clarity":2}')["relevance"] == 7.0
    assert answers.parse_verdict("nothing")["error"] == "nothing"


PAGE = """<html><head><title>T</title></head><body><nav><p>menu menu menu menu</p></nav><main><h1>A heading</h1><h2>A heading that is longer</h2><p>First <b>paragraph</b> text.</p><p>First <b>paragraph</b> text.</p>
<ul><li>item one x</li><li>item two y</li><li>z</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2 and more</td></tr><tr><td>lone cell</td></tr></table>
<div class="qa"><b class="toggle">Who pays?</b><p class="panel">The one who has ordered it.</p></div><h2>Is it so?</h2><p>Yes, it is.</p><div>no</div><h5>small</h5><ul><li>And more.</li></ul><h4>End</h4><p>Not this.</p></main>
<a href="/b?x=1">b</a><a href="http://o.org/c">c</a><a href="d.pdf">d</a><a href="#t">t</a></body></html>"""


def test_html():
    p = html.page_data(PAGE, "http://e.org/a")
    assert p["title"] == "T"
    assert p["chunks"] == ["Section: A heading that is longer", "Firstparagraphtext.", "Items: item one x; item two y", "Table data: Table columns: h, k; h: 1 | k: 2 and more; lone cell", "The one who has ordered it."]
    assert p["faqs"] == [{"question": "Who pays?", "answer": "The one who has ordered it."}, {"question": "Is it so?", "answer": "Yes, it is. And more."}]
    assert p["links"] == ["http://e.org/b", "http://e.org/d.pdf"] and p["documents"] == ["http://e.org/d.pdf"]
    assert html.page_data(PAGE, "http://e.org/a", " ")["chunks"][1] == "First paragraph text."
    assert html.page_data(None, None)["chunks"] == []


def test_markdown():
    flat = html.markdown(PAGE, "http://e.org/a")
    assert flat.startswith("# T\n\nSource: http://e.org/a\n\n# A heading\n\n## A heading that is longer\n\nFirstparagraphtext.") and "menu" not in flat and "| 2 and more" in flat
    assert html.full_markdown(PAGE, "u") is None  # too short
    full = html.full_markdown(PAGE.replace("Yes, it is.", "Yes, <a href='/w'>it</a> is. " + "word " * 100), "http://e.org/a")
    assert full.startswith("Source: http://e.org/a\n\n# A heading\n") and "First **paragraph** text." in full and "- item one x\n- item two y" in full and "| 1 | 2 and more |" in full and "[it](/w)" in full


def test_urls(spark):
    assert one(spark, url.visit_key(F.lit("HTTP://E.org/A/?q#f"))) == "http://e.org/a"
    assert one(spark, url.excluded(F.lit("http://e.org/a?q=1"))) and one(spark, url.is_document(F.lit("http://e.org/a.PDF?x")))
    assert [one(spark, url.excluded(F.lit("http://e.org" + x))) for x in ("/register", "/api/x", "/printers", "/print/x", "/share", "/Login", "/a.css")] == [True, True, False, True, False, False, False]
    assert one(spark, url.same_site(F.lit("http://www.e.org/x"), F.lit("e.org")))
    assert [one(spark, url.file_name(F.lit(x))) for x in ("http://e.org/a/b?q=1", "http://e.org", "http://e.org/a/_b--c/%20d/", "http://e.org/" + "x" * 200)] == ["a_b.json", "index.json", "a_b--c_20d.json", "x" * 100 + ".json"]
    assert one(spark, text.clean_text(F.lit("a\n \n\t\n\nb  c Back To Top share this page"))) == "a\n\nb c  share this page"


def test_prompt(spark):
    assert "Q?" in one(spark, text.prompt(text.TERMS_PROMPT, question=F.lit("Q?")))
