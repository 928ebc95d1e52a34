"""Hybrid retrieval for a batch of queries, and whether its evidence suffices."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.balance import SEPARATOR, balanced_top_k, facet_key
from filigree.operators.context import attach, excerpt
from filigree.operators.fusion import fused, reciprocal_rank_fusion
from filigree.operators.lexical import lexical_search
from filigree.operators.semantic import semantic_search

LIST_DEPTH = 50
FINAL_K = 10
COSINE_FLOOR = 0.2


def hybrid_search(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    k: int = FINAL_K,
    *,
    depth: int = LIST_DEPTH,
    where: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Lexical and semantic lists of `depth`, fused to the top `k` per query.

    `where` restricts on metadata columns of `docs` before anything is scored; term
    statistics stay those of the whole corpus. Vectors without a document are left out
    before the lists are cut, so a query gets `k` hits if it has so many candidates.
    """
    kept = docs if where is None else docs.where(where)
    kept_vectors = vectors.join(kept.select(id_col), id_col, "left_semi")
    lists = {
        "lexical": lexical_search(kept, queries, depth, id_col=id_col, text_col=text_col, corpus=docs),
        "semantic": semantic_search(kept_vectors, query_vectors, depth, id_col=id_col),
    }
    return reciprocal_rank_fusion(lists, k, id_col=id_col)


def balanced_search(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    facets: list[str],
    k: int = FINAL_K,
    *,
    depth: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Hybrid search in which each combination of the facets keeps its share of `k`.

    Both lists hold the best `depth` of every combination; the shares are dealt after
    fusion. Gives the fused columns, the facets, `turn` and `rank`.
    """
    keyed = docs.withColumn("_facet", facet_key(facets))
    lists = {
        "lexical": lexical_search(keyed, queries, depth, id_col=id_col, text_col=text_col, facet_col="_facet"),
        "semantic": semantic_search(vectors.join(keyed.select(id_col, "_facet"), id_col), query_vectors, depth, id_col=id_col, facet_col="_facet"),
    }
    found = balanced_top_k(fused(lists, id_col=id_col, keep=("_facet",)), "_facet", k, id_col=id_col)
    parts = F.split("_facet", SEPARATOR)
    return found.withColumns({f: parts[i] for i, f in enumerate(facets)}).drop("_facet")


def search_filings(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    metadata: list[str],
    k: int = FINAL_K,
    *,
    where: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The bounded search tool: hybrid hits with their metadata and an excerpt.

    No hit is lost when its document can't be shown; its metadata are then null.
    """
    hits = hybrid_search(docs, vectors, queries, query_vectors, k, where=where, id_col=id_col, text_col=text_col)
    shown = docs.select(id_col, *metadata, excerpt(F.col(text_col)).alias("excerpt"))
    return attach(hits, shown, id_col, k * queries.count(), how="left")


def evidence_status(
    queries: DataFrame, lexical: DataFrame, semantic: DataFrame, floor: float = COSINE_FLOOR, lexical_floor: float = 0.0
) -> DataFrame:
    """`(query_id, n_lexical, best_cosine, status)` for every query.

    A query without any lexical hit of score `lexical_floor` and without a vector above
    `floor` is `insufficient`.
    """
    words = lexical.where(F.col("score") >= lexical_floor).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lexical"))
    near = semantic.groupBy("query_id").agg(F.max("score").alias("best_cosine"))
    known = queries.select("query_id").join(words, "query_id", "left").join(near, "query_id", "left")
    n = F.coalesce("n_lexical", F.lit(0))
    weak = (n == 0) & (F.coalesce("best_cosine", F.lit(-1.0)) < floor)
    return known.select(
        "query_id",
        n.alias("n_lexical"),
        "best_cosine",
        F.when(weak, F.lit("insufficient")).otherwise(F.lit("ok")).alias("status"),
    )
