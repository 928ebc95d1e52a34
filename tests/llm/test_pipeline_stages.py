import os

import pytest
from cases import awkward, empty
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_groups
from test_token_files import check_sequences

import corpus_pipeline
from filigree.llm.common import written

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, docs):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(f"test{i}" for i in range(15)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, tmp_path):
    body = lambda i: "\n".join(" ".join(f"w{(i * 37 + j * j + k) % 4001}" for j in range(12)) for k in range(0, 60, 7))
    rows = [(i, f"{body(i)}\n{'vile idiot' if i % 3 == 0 else 'fine person'}") for i in range(60)]
    rows += [(100 + i, body(i) + f"\nand a tail of {i} words") for i in range(1, 60, 4)]
    rows += [(200, f"{body(70)}\n{' '.join(f'test{i}' for i in range(15))}"), (201, "a vile idiot again and again")]
    path = folder(spark, tmp_path, awkward(spark, rows))
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    kept = {n: {r.doc_id: r.text for r in d.collect()} for n, d in seen.items() if n != "packing"}
    assert set(kept["toxicity"]) == {i for i, t in rows if "idiot" not in t}
    lines = dict(brute_lines(list(kept["toxicity"].items())))
    assert kept["line_dedup"] == lines
    firsts = {d for d, c, _ in brute_groups(sorted(lines.items())) if d == c}
    blank = sorted(d for d, t in lines.items() if not t.strip())
    assert set(kept["jaccard_join"]) == firsts - set(blank[1:])
    assert set(kept["decontamination"]) == set(kept["jaccard_join"]) - {200}
    frame = seen["packing"].toPandas()
    assert set(frame["doc_id"]) == set(kept["decontamination"])
    check_sequences(frame, 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, seen["packing"].select("doc_id", "piece", "ids_crc32").collect())
    )


def test_awkward_and_empty_documents(spark, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        path = folder(spark, tmp_path / name, docs)
        frame = corpus_pipeline.run(spark, path)
        assert (frame.count() > 0) == (name == "awkward")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_given_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
