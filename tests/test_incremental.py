from datetime import date

import pytest
from pyspark.sql import functions as F

from filigree.functions.embedding import HashingEmbedder
from filigree.operators import incremental
from filigree.operators.incremental import update_tables
from filigree.plans.ingest import store_corpus, update_corpus
from filigree.schemas import SOURCE_DOCUMENTS
from filigree.session import stored


def derive(rows):
    return rows.select("id", "part", F.explode(F.split("text", " ")).alias("word"))


def arrive(spark, path, rows, **options):
    frame = spark.createDataFrame(rows, "id int, part string, text string")
    counts = update_tables(frame, path, derive, id_col="id", partition="part", **options)
    words = {(r.id, r.part, r.word, r.generation) for r in spark.read.parquet(f"{path}/chunks").collect()}
    docs = {(r.id, r.part, r.text) for r in spark.read.parquet(f"{path}/documents").collect()}
    return counts, words, docs


def test_only_what_changed_is_derived_again(spark, tmp_path):
    path = str(tmp_path / "t")
    counts, words, _ = arrive(spark, path, [(1, "a", "x y"), (2, "a", "z"), (3, "b", "w"), (4, None, "n"), (None, "a", "no id")])
    assert counts == {"unchanged": 0, "added": 4, "changed": 0, "removed": 0, "derived": 5}
    assert {w[:3] for w in words} == {(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, "b", "w"), (4, None, "n")}
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "chunks" / "part=b").iterdir()}

    counts, words, docs = arrive(spark, path, [(1, "a", "x v"), (2, "a", "z"), (3, "b", "w"), (1, "a", "x v")])
    assert counts == {"unchanged": 2, "added": 0, "changed": 1, "removed": 0, "derived": 2}
    assert words == {(1, "a", "x", 2), (1, "a", "v", 2), (2, "a", "z", 1), (3, "b", "w", 1), (4, None, "n", 1)}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "chunks" / "part=b").iterdir()} == untouched

    # a document moves to another partition, and leaves its own one empty
    counts, words, docs = arrive(spark, path, [(3, "c", "w"), (4, None, "m")])
    assert counts["changed"] == 2 and (3, "c", "w", 3) in words and not [w for w in words if w[1] == "b"]
    assert docs == {(1, "a", "x v"), (2, "a", "z"), (3, "c", "w"), (4, None, "m")}

    counts, words, docs = arrive(spark, path, [(2, "a", "z")], complete=True)
    assert counts == {"unchanged": 1, "added": 0, "changed": 0, "removed": 3, "derived": 0}
    assert words == {(2, "a", "z", 1)} and docs == {(2, "a", "z")}
    assert arrive(spark, path, [(2, "a", "z")])[0]["derived"] == 0


def strict(*allowed):
    """An embedder that fails on any passage but the allowed ones."""

    class Strict:
        dim = 8

        def embed(self, texts):
            assert all(any(a in t for a in allowed) for t in texts), texts
            return [[1.0] * 8 for _ in texts]

    return Strict()


def documents(spark, texts, year=2024):
    rows = [(i, "T", "Acme", "10-K", date(year, 1, 1), year, i, "u", t) for i, t in texts.items()]
    return spark.createDataFrame(rows, SOURCE_DOCUMENTS)


def test_an_update_embeds_only_the_changed_document(spark, tmp_path):
    path = str(tmp_path / "corpus")
    texts = {f"d{i}": f"# Risk\n\nbody of {i}" for i in range(5)}
    store_corpus(documents(spark, texts), HashingEmbedder(8), path)
    texts["d3"] += " amended"
    counts = update_corpus(documents(spark, texts), strict("amended"), path)
    assert counts == {"unchanged": 4, "added": 0, "changed": 1, "removed": 0, "derived": 1}
    store_corpus(documents(spark, {"e": "new words"}, 2025), strict("new"), path, clear=False)
    chunks = spark.read.parquet(f"{path}/document_chunks")
    assert {(r.document_id, r.generation) for r in chunks.collect()} == {*((f"d{i}", 1) for i in (0, 1, 2, 4)), ("d3", 2), ("e", 3)}
    assert chunks.where("year = 2025").count() == 1 and chunks.where("size(embedding) = 8").count() == 6


def test_rows_of_an_update_are_written_once(spark, tmp_path, monkeypatch):
    """A touched partition is replaced in one write; one left empty, also by what a failed
    update wrote, holds nothing afterwards."""
    names = []
    monkeypatch.setattr(incremental, "stored", lambda df, name: names.append(name) or stored(df, name))
    path = str(tmp_path / "t")
    arrive(spark, path, [(1, "a", "x y"), (2, "a", "z"), (3, "b", "w")])
    _, words, _ = arrive(spark, path, [(1, "a", "v")])
    assert names == ["changed"] * 2 and words == {(1, "a", "v", 2), (2, "a", "z", 1), (3, "b", "w", 1)}

    replace = incremental._replace
    monkeypatch.setattr(incremental, "_replace", lambda to, *a: replace(to, *a) if to.endswith("chunks") else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        arrive(spark, path, [(3, "b", "half done")])
    monkeypatch.setattr(incremental, "_replace", replace)
    _, words, docs = arrive(spark, path, [(3, "c", "moved"), (2, "a", "z")])
    assert {w[:3] for w in words} == {(1, "a", "v"), (2, "a", "z"), (3, "c", "moved")}
    assert docs == {(1, "a", "v"), (2, "a", "z"), (3, "c", "moved")}
