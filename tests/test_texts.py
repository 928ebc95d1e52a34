from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.functions.html import markdown, sections, title, unescape
from filigree.functions.text import tokens
from filigree.operators.chunking import chunk_documents, chunk_sections
from filigree.operators.lexical import postings


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).collect()[0][0]


def test_unescape_decodes_once(spark):
    assert one(spark, unescape, "&amp;lt; &#8217;&#x41; & &bogus; &lt;b&gt; AT&T") == "&lt; ’A & &bogus; <b> AT&T"
    assert one(spark, unescape, "plain") == "plain"


HTML = (
    "<html><head><title> A &amp; B </title></head><body><script>var t='</p>';</script><nav>x</nav>"
    "intro<!-- c --><h2>Risk  Factors</h2><p>one<br>two</p><ul><li>a<li>b</ul>"
    "<table><tr><td>1</td><td>2</td></tr></table><p style='page-break-before: always'>three"
)


def test_markdown(spark):
    assert one(spark, markdown, HTML) == (
        "intro\n\n## Risk Factors\n\none\ntwo\n\n- a\n- b\n\n| 1 | 2 |\n| --- | --- |\n\n\fthree"
    )
    assert one(spark, title, HTML) == "A & B"
    assert one(spark, title, "<p>none") is None


def test_sections_tile_the_text(spark):
    df = spark.createDataFrame([(HTML,)], "h string").select(markdown(F.col("h")).alias("md"))
    row = df.select("md", sections(F.col("md")).alias("s")).collect()[0]
    assert "".join(s["text"] for s in row["s"]) == row["md"]
    assert [s["start"] for s in row["s"]] == [row["md"].index(s["text"]) for s in row["s"]]
    assert [(s["section"], s["page"]) for s in row["s"]] == [(None, 1), ("Risk Factors", 1), ("Risk Factors", 2)]
    assert one(spark, sections, None) == []


words = st.lists(st.text("ab é\n\t", min_size=1, max_size=6), max_size=60).map(" ".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(words, min_size=1, max_size=12))
def test_chunks_are_spans_that_cover_the_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in chunk_documents(docs, size=7, stride=5).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for doc, text in enumerate(texts):
        chunks = sorted(found.get(doc, []), key=lambda r: r["chunk_index"])
        n = len(text.split())
        assert len(chunks) == (0 if n == 0 else 1 if n <= 7 else 1 + -(-(n - 7) // 5))
        assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
        said = []
        for c in chunks:
            assert text[c["start"] : c["end"]] == c["text"]
            assert c["token_count"] == len(c["text"].split()) <= 7
            said += c["text"].split()[2 if said else 0 :]
        assert said == text.split()


def test_section_chunks_keep_to_their_section(spark):
    md = "# One\n\n" + "w " * 9 + "\n\n# Two\n\nlast words"
    docs = spark.createDataFrame([("d", md)], "document_id string, md string")
    cut = chunk_sections(docs.withColumn("sections", sections(F.col("md"))), size=5, stride=4).orderBy("chunk_index")
    rows = cut.collect()
    assert [r["section"] for r in rows] == ["One"] * 3 + ["Two"]
    assert [r["chunk_id"] for r in rows] == ["d-0", "d-1", "d-2", "d-3"]
    assert all(md[r["start"] : r["end"]] == r["text"] for r in rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("abc -É", max_size=40), min_size=1, max_size=12))
def test_postings(spark, texts):
    import re
    from collections import Counter

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for doc, text in enumerate(texts):
        found = re.findall("[a-z0-9]+", text.lower())
        want |= {(term, doc, tf, len(found)) for term, tf in Counter(found).items()}
    assert {tuple(r) for r in postings(df).collect()} == want


def test_unicode_tokens(spark):
    assert one(spark, lambda c: tokens(c, unicode=True), "Größe l'été 42") == ["größe", "l", "été", "42"]
    assert one(spark, tokens, None) == []


def test_sections_keep_every_character(spark):
    text = "a\u0001b\n# One\u0001\n\u0001# x\f## Two\ntail\f\f"
    parts = one(spark, sections, text)
    assert "".join(p["text"] for p in parts) == text
    assert [(p["section"], p["page"]) for p in parts] == [(None, 1), ("One\u0001", 1), ("Two", 2), ("Two", 3), ("Two", 4)]


def test_sections_of_many_headings(spark):
    text = "".join(f"# h{i}\nbody\n" for i in range(5000))
    parts = one(spark, sections, text)
    assert len(parts) == 5000 and parts[-1]["section"] == "h4999" and parts[-1]["section_index"] == 4999
    assert parts[-1]["start"] + len(parts[-1]["text"]) == len(text)
