import json

import pytest
from pyspark.sql import functions as F

from filigree.functions.embedding import HashingEmbedder
from filigree.operators.semantic import semantic_search
from filigree.plans.ingest import source_documents, store_corpus
from filigree.plans.search import CorpusTools
from filigree.schemas import DOCUMENT_CHUNKS, SOURCE_DOCUMENTS
from filigree.sinks.files import export_raw_files, write_raw_table
from filigree.sources.raw_files import fetch, fetch_json, read_raw_files, stream_raw_files

HTML = "<h1>Acme 10-K</h1>cover<h2>Risk Factors</h2><p>supply chain risk</p><h2>MD&amp;A</h2><p>revenue grew</p>"


@pytest.fixture()
def landed(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    (site / "a.htm").write_text(HTML)
    (site / "page.json").write_text(json.dumps({"form": ["10-K"]}))
    rows = [("2024/t1_10-k.htm", (site / "a.htm").as_uri(), "2024")]
    urls = spark.createDataFrame(rows, "local_path string, url string, year string")
    return site, fetch(urls, user_agent="tests t@example.com", pause=0)


def test_fetch_export_and_read_back(spark, landed, tmp_path):
    site, fetched = landed
    out = tmp_path / "downloads"
    written = export_raw_files(fetched, out.as_uri()).collect()
    assert [(r["local_path"], r["bytes"]) for r in written] == [("2024/t1_10-k.htm", len(HTML))]
    raw = read_raw_files(spark, str(out)).collect()
    assert [(r["local_path"], r["year"], r["html"]) for r in raw] == [("2024/t1_10-k.htm", "2024", HTML)]
    query = stream_raw_files(spark, str(out)).writeStream.format("memory").queryName("raw").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("raw").count() == 1
    write_raw_table(fetched, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("year = 2024").count() == 1
    pages = fetch_json(spark.createDataFrame([((site / "page.json").as_uri(),)], "url string"), user_agent="t")
    assert json.loads(pages.collect()[0]["json"]) == {"form": ["10-K"]}


def test_fetch_errors_fail_the_job(spark, tmp_path):
    urls = spark.createDataFrame([((tmp_path / "absent").as_uri(),)], "url string")
    with pytest.raises(Exception, match="absent"):
        fetch(urls, user_agent="t", pause=0).collect()


def test_raw_html_to_searchable_chunks(spark, landed, tmp_path):
    _, fetched = landed
    raw = fetched.select("local_path", F.decode("content", "UTF-8").alias("html"))
    filings = spark.createDataFrame(
        [("2024/t1_10-k.htm", "T1", "10-K", "2024-11-01", "acc-1", "https://x/a.htm")],
        "local_path string, ticker string, form string, filing_date string, accession_number string, source_url string",
    )
    companies = spark.createDataFrame([("T1", "Acme")], "ticker string, company string")
    embedder = HashingEmbedder(64)
    store_corpus(source_documents(raw, filings, companies), embedder, str(tmp_path / "corpus"))
    docs = spark.read.parquet(str(tmp_path / "corpus" / "source_documents"))
    assert set(docs.columns) == {*SOURCE_DOCUMENTS.names, "content_hash", "generation"}
    chunks = spark.read.schema(DOCUMENT_CHUNKS).parquet(str(tmp_path / "corpus" / "document_chunks"))
    rows = chunks.orderBy("chunk_index").collect()
    assert [r["section"] for r in rows] == ["Acme 10-K", "Risk Factors", "MD&A"]
    markdown = docs.collect()[0]["markdown"]
    for r in rows:
        span = r["metadata"]["offsets"]
        assert markdown[span["start"] : span["end"]] == r["text"]
        assert r["metadata"]["company"] == "Acme" and r["metadata"]["year"] == 2024
        assert len(r["embedding"]) == 64
    tools = CorpusTools(spark, str(tmp_path / "corpus"), embedder)
    query = spark.createDataFrame([(1, "supply chain risk")], "query_id int, text string")
    hits = tools.search_filings(query, 3, where=tools.restrict(["T1"], [2024], ["10-K"])).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == "acc-1-1" and hits[0]["section"] == "Risk Factors"
    assert tools.search_filings(query, 3, where=tools.restrict(years=[2020])).count() == 0
    even = tools.search_filings(query, 3, balance="ticker").orderBy("rank").collect()
    assert [h["chunk_id"] for h in even] == [h["chunk_id"] for h in hits]
    assert tools.read_chunk("acc-1-2").collect()[0]["section"] == "MD&A"
    near = spark.createDataFrame([(1, "acc-1", 1)], "query_id int, document_id string, chunk_index int")
    assert {r["chunk_id"] for r in tools.read_surrounding_chunks(near).collect()} == {"acc-1-0", "acc-1-1", "acc-1-2"}
    asked = [float(x) for x in embedder.embed(["supply chain risk"])[0]]
    queries = spark.createDataFrame([(1, asked)], "query_id int, embedding array<float>")
    best = semantic_search(chunks, queries, 1, id_col="chunk_id", dim=64).collect()
    assert best[0]["chunk_id"] == "acc-1-1"
