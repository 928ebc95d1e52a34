import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import lexical, topk
from filigree.operators.bounded import lookup_join
from filigree.operators.context import attach, excerpt, surrounding_chunks
from filigree.operators.fusion import reciprocal_rank_fusion
from filigree.operators.lexical import lexical_search
from filigree.operators.retrieval import evidence_status, hybrid_search, search_filings
from filigree.operators.semantic import semantic_search, similarity
from filigree.session import stored

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(WORDS, weights=range(10, 0, -1), k=rng.randint(0, 12))), f"s{i % 3}")
            for i in range(80)]
    docs += [(80 + i, "alpha beta beta", "hot") for i in range(40)]  # a third are copies
    queries = [(q, " ".join(rng.sample(WORDS, 3))) for q in range(9)] + [(9, "unknown words"), (10, "")]
    return docs, queries


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, queries = corpus
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3),
        spark.createDataFrame(queries, "query_id long, text string"),
    )


def bm25(docs, queries, k):
    split = {d: t.split() for d, t, _ in docs}
    mean = sum(map(len, split.values())) / len(split)
    df = Counter(w for words in split.values() for w in set(words))
    out = set()
    for q, text in queries:
        scored = []
        for d, words in split.items():
            tf = Counter(words)
            s = sum(
                math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2
                / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
                for w in set(text.split()) if tf[w]
            )
            if s > 0:
                scored.append((-round(s, 6), d))
        out |= {(q, d, -s, r) for r, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


RANKED = ("query_id", "doc_id", "score", "rank")


@pytest.mark.parametrize("k", [1, 7, 500])
def test_lexical_is_bm25_with_ties_by_id(frames, corpus, k):
    assert rows(lexical_search(*frames, k), *RANKED) == bm25(*corpus, k)


@pytest.mark.parametrize("slice_rows", [6, 2])
def test_query_slices_change_nothing(frames, corpus, slice_rows):
    got = lexical_search(*frames, 5, slice_rows=slice_rows)
    assert rows(got, *RANKED) == bm25(*corpus, 5)


def test_many_query_slices_go_through_a_stored_table(spark, frames, corpus):
    assert rows(lexical_search(*frames, 5, slice_rows=8), *RANKED) == bm25(*corpus, 5)


def test_facets_and_corpus_statistics(frames, corpus):
    docs, queries = frames
    every = bm25(*corpus, 500)
    source = {d: s for d, _, s in corpus[0]}
    got = lexical_search(docs, queries, 2, facet_col="source")
    for r in got.collect():
        same = sorted((-s, d) for q, d, s, _ in every if q == r["query_id"] and source[d] == r["source"])
        assert same[r["rank"] - 1] == (-r["score"], r["doc_id"])
    hot = lexical_search(docs.where("source = 'hot'"), queries, 500, corpus=docs)
    assert rows(hot, "query_id", "doc_id", "score") == {(q, d, s) for q, d, s, _ in every if source[d] == "hot"}


def test_empty_inputs(frames):
    docs, queries = frames
    assert lexical_search(docs.where("false"), queries, 3).count() == 0
    assert lexical_search(docs, queries.where("false"), 3).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12))
    base[200:] = base[7]  # a third of the vectors are copies
    asked = base[:20] + 0.1 * rng.normal(size=(20, 12))
    def frame(m, name):
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                     f"{name} long, embedding array<float>")
    return frame(base, "doc_id").repartition(4), frame(asked, "query_id")


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "l2"])
def test_semantic_matches_the_native_expression(vectors, metric):
    stored, asked = vectors
    pairs = asked.withColumnRenamed("embedding", "q").crossJoin(stored)  # small fixture
    brute = {}
    for r in pairs.select("query_id", "doc_id", similarity(F.col("q"), F.col("embedding"), metric).alias("s")).collect():
        brute.setdefault(r["query_id"], []).append((-round(r["s"], 6), r["doc_id"]))
    got = semantic_search(stored, asked, 9, metric=metric).collect()
    assert len(got) == 20 * 9
    for r in got:
        want = sorted(brute[r["query_id"]])[r["rank"] - 1]
        assert r["score"] == pytest.approx(-want[0], abs=2e-6)
        assert metric == "l2" or r["doc_id"] == want[1]


def test_semantic_rejects_other_dimensions(spark, vectors):
    short = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        semantic_search(vectors[0], short, 3).collect()
    with pytest.raises(ValueError):
        semantic_search(*vectors, 3, dim=1536)


def test_fusion_hand_worked(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "d", 2)], "query_id int, doc_id string, rank int")
    got = reciprocal_rank_fusion({"semantic": a, "lexical": b}, 10).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["rrf_score"], 9)) for r in got] == [
        ("b", 0.032522475), ("a", 0.016393443), ("d", 0.016129032), ("c", 0.015873016),
    ]
    assert (got[0]["semantic_rank"], got[0]["lexical_rank"]) == (2, 1)


def test_hybrid_filter_restricts_both_lists(frames, vectors):
    docs, queries = frames
    found = hybrid_search(docs, vectors[0], queries, vectors[1], 5, where=F.col("source") == "hot")
    assert {r["doc_id"] for r in found.collect()} <= set(range(80, 120))


def test_evidence(spark, frames):
    docs, queries = frames
    far = spark.createDataFrame([(9, 0.1), (10, 0.4)], "query_id long, score double")
    status = evidence_status(queries, lexical_search(docs, queries, 3), far)
    got = {r["query_id"]: r["status"] for r in status.collect()}
    assert got[9] == "insufficient" and got[10] == "ok" and got[0] == "ok"


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_lookup_join_with_a_hot_key(spark, max_rows):
    facts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"))
    lookup = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = lookup_join(facts, lookup, "k", ["id"], max_rows=max_rows)
    assert got.count() == 300
    assert got.where("v <> k * 10 OR (v IS NULL) <> (k > 14)").count() == 0


@pytest.mark.parametrize("bound", [100, None])
def test_neighbours(spark, bound):
    chunks = spark.createDataFrame(
        [(d, i, f"{d}-{i}", f"text {d} {i}") for d in "ab" for i in range(4)],
        "document_id string, chunk_index int, chunk_id string, text string",
    )
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "b", 3)], "query_id int, document_id string, chunk_index int")
    got = surrounding_chunks(hits, chunks, hits_bound=bound)
    assert rows(got, "query_id", "chunk_id", "offset") == {
        (1, "a-0", 0), (1, "a-1", 1), (1, "b-1", -1), (1, "b-2", 0), (1, "b-3", 1), (2, "b-2", -1), (2, "b-3", 0),
    }
    same = attach(hits.select("query_id", F.lit("a-1").alias("chunk_id")), chunks, "chunk_id", bound)
    assert same.count() == 3


def test_facets_emit_at_most_k_per_task(spark):
    """A thousand facets over many blocks: k rows per task, query and facet, and no more."""
    docs = spark.range(0, 40_000, 1, 2).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"), (F.col("id") % 1000).alias("facet")
    )
    queries = spark.createDataFrame([(i, f"word w{i % 7}") for i in range(300)], "query_id long, text string")
    found = lexical_search(docs, queries.where("query_id < 20"), 2, facet_col="facet")
    assert found.count() == 20 * 1000 * 2
    assert topk.facet_slice(docs, "facet", 8192) == topk.FACET_CELLS // 1000


def test_every_query_gets_its_hits(spark):
    """Vectors without a document take no place of those that have one."""
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(12)], "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(100)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "nothing shared"), (2, "text 3")], "query_id long, text string")
    asked = spark.createDataFrame([(1, [1.0, 99.0]), (2, [1.0, 50.0])], "query_id long, embedding array<float>")
    found = search_filings(docs, vectors, queries, asked, ["lang"], 10).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in found] == [*range(1, 11)] * 2
    assert all(r["lang"] == "en" and r["excerpt"] for r in found)


def test_terms_are_counted_once_for_all_slices(frames, corpus, monkeypatch):
    calls = []
    monkeypatch.setattr(lexical, "stored", lambda df, name: calls.append(name) or stored(df, name))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    assert rows(lexical_search(*frames, 5, slice_rows=4), *RANKED) == bm25(*corpus, 5)
    assert calls == ["term-statistics"]


@pytest.mark.parametrize("names", [False, True])
def test_a_task_keeps_the_best_of_inexact_scores(names, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topk, "SCORE_CELLS", 200)
    rng = np.random.default_rng(3)
    true = np.round(rng.integers(0, 40, (90, 12)) / 8.0, 6)
    ids = pa.array([f"d{i}" for i in rng.permutation(90)] if names else rng.permutation(90))
    facets = pa.array(["a", "b", None] * 30)
    for column in (None, facets):
        best = topk.TaskTopK(12, 4)
        for at in range(0, 90, 30):
            part = true[at : at + 30]
            for first in (0, 5):
                block = part[:, first : first + 5 if first == 0 else None]
                near = block * (1 + rng.uniform(-1e-4, 1e-4, block.shape))
                best.offer(near, ids[at : at + 30], None if column is None else column[at : at + 30], first, 0.0, lambda d, q, b=block: b[d, q], 1e-4)
        values, facet, query, kept, score = best.drain()
        told = {(values[f], q, i, s) for f, q, i, s in zip(facet, query, kept, score)}
        wanted = set()
        for value in {None} if column is None else set(column.to_pylist()):
            own = [i for i in range(90) if column is None or column[i].as_py() == value]
            for q in range(12):
                ranked = sorted((-true[i, q], ids[i].as_py()) for i in own if true[i, q] > 0)[:4]
                wanted |= {(value, q, i, -s) for s, i in ranked}
        assert told == wanted


def test_many_short_queries_read_the_texts_once(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(50)], "doc_id long, text string")
    asked = spark.range(40_000).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 50).alias("text"))
    found = lexical_search(docs, asked, 1)
    assert not any("query-slices" in f for f in found.inputFiles())
    assert found.where("query_id >= 39950").count() == 50


def test_blocks_of_scores_take_the_same_memory():
    import numpy as np
    import pyarrow as pa

    from filigree.operators.lexical import AskedTerms, Cells, Wanted

    rng, n_terms = np.random.default_rng(3), 300
    pairs = [(q, t) for q in range(40) for t in np.sort(rng.choice(n_terms, 120, replace=False))]
    query, term = (np.array(x, np.int32) for x in zip(*pairs))
    asked = AskedTerms(Wanted(pa.array(range(40)), [str(t) for t in range(n_terms)], query, term), 0, 40)
    matrix = np.zeros((40, n_terms))
    matrix[query, term] = 1.0
    held, seen = Cells(), []
    for n_docs in (60, 25):
        values = rng.random((n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < 0.4)
        doc, at = np.nonzero(values)
        scores, exact = asked.score(doc, np.arange(n_terms), at, values[doc, at], n_docs, held)
        true = values @ matrix.T
        assert (abs(scores - true) <= asked.slack * true).all() and scores.dtype == np.float32
        where = np.nonzero(true > 0)
        assert np.allclose(exact(*where), true[where], rtol=1e-12, atol=0)
        seen.append(scores)
    assert np.shares_memory(*seen)


def test_several_slices_cut_the_texts_once(spark, frames, corpus):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = frames[0].withColumn("text", seen("text"))
    assert rows(lexical_search(docs, frames[1], 5, slice_rows=4), *RANKED) == bm25(*corpus, 5)
    assert read.value == len(corpus[0])


def test_several_slices_cut_the_queries_once(spark, frames, corpus):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    asked = frames[1].withColumn("text", seen("text"))
    assert rows(lexical_search(frames[0], asked, 5, slice_rows=4), *RANKED) == bm25(*corpus, 5)
    assert read.value == frames[1].count()


def test_excerpts_hold_the_first_characters_with_white_space_as_one(spark):
    long = [None, "", " \n ", "  a \t b ", "\n\t" * 300 + "x", "é  " * 250, "😀 \n" * 230, "a" * 500, "a b\x0bc  d" * 60]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, text string").select("i", excerpt(F.col("text")).alias("e"))
    told = dict(map(tuple, found.collect()))
    assert told == {i: None if t is None else re.sub("[ \t\r\n\f]+", " ", t)[:200].strip(" ") for i, t in enumerate(long)}


def test_tiles_of_a_group_score_as_the_whole():
    import pyarrow as pa

    from filigree.operators.lexical import AskedTerms, Cells, Wanted

    rng, n_terms = np.random.default_rng(5), 400
    pairs = [(q, t) for q in range(30) for t in np.sort(rng.choice(n_terms, 1 + q, replace=False))]
    query, term = (np.array(x, np.int32) for x in zip(*pairs))
    asked = AskedTerms(Wanted(pa.array(range(30)), [str(t) for t in range(n_terms)], query, term), 0, 30)
    matrix = np.zeros((30, n_terms))
    matrix[query, term] = 1.0
    # Some terms in every document, most in few: dense rows and expanded products.
    values = rng.random((500, n_terms)) * (rng.random((500, n_terms)) < np.where(np.arange(n_terms) % 20 == 0, 1.0, 0.01))
    doc, at = np.nonzero(values)
    group = asked.group(*asked.entries(doc, np.arange(n_terms), at, values[doc, at]), 500)
    assert 0 < group.rows.shape[1] < n_terms and len(group.doc)
    held = Cells()
    for first, last in ((0, 200), (200, 400), (400, 500)):
        scores, exact = group.tile(first, last, held)
        true = values[first:last] @ matrix.T
        assert (abs(scores - true) <= asked.slack * true).all()
        where = np.nonzero(true > 0)
        assert np.allclose(exact(*where), true[where], rtol=1e-12, atol=0)


def test_waiting_candidates_are_ranked_with_ties_by_id(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    true = rng.integers(1, 6, (400, 3)) / 2.0
    ids = rng.permutation(400)
    for waiting in (1, 5, 1000):
        monkeypatch.setattr(topk, "WAITING", waiting)
        best = topk.TaskTopK(3, 6)
        for at in range(0, 400, 7):
            best.offer(true[at : at + 7], pa.array(ids[at : at + 7]))
        _, _, query, kept, _ = best.drain()
        for q in range(3):
            assert list(kept[query == q]) == [i for _, i in sorted(zip(-true[:, q], ids))[:6]]
