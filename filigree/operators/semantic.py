"""Exact vector retrieval: every task scores its vectors and keeps its best k."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.bounded import QUERY_SLICE, in_query_slices
from filigree.operators.topk import (
    SCORE_DIGITS,
    TaskTopK,
    blocks,
    candidate_batch,
    candidate_schema,
    facet_slice,
    facets_of,
    for_scoring,
    rank_candidates,
    typed_ids,
)

METRICS = ("cosine", "inner_product", "l2")


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Pairwise similarity of two vector columns as a native expression (larger is closer)."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    if metric == "inner_product":
        return dot(a, b)
    if metric == "l2":
        squares = F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0)))
        return -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "doc_id",
    metric: str = "cosine",
    facet_col: str | None = None,
    dim: int | None = None,
    slice_rows: int = QUERY_SLICE,
) -> DataFrame:
    """Top `k` vectors per query (and facet): `(query_id, [facet], id, score, rank)`.

    `vectors` holds `(id, embedding)`, `queries` `(query_id, embedding)`. Recall is 1:
    all vectors are scored. Vectors of another dimension than the queries fail the job.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    def one_slice(part: DataFrame, _: DataFrame) -> DataFrame:
        ids, matrix = query_matrix(part, dim)
        columns = [id_col, "embedding", *([facet_col] if facet_col else [])]
        rows = for_scoring(vectors.where(F.col("embedding").isNotNull()).select(*columns))
        scored = rows.mapInArrow(
            _score_task(ids, matrix, k, id_col, facet_col, metric),
            candidate_schema(queries, vectors, id_col, facet_col),
        )
        return rank_candidates(scored, k, id_col, facet_col)

    return in_query_slices(queries, one_slice, facet_slice(vectors, facet_col, slice_rows, k))


def query_matrix(part: DataFrame, dim: int | None):
    """The slice's query ids and their vectors as one float64 matrix."""
    import numpy as np

    rows = part.select("query_id", "embedding").collect()
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    if rows and (matrix.ndim != 2 or (dim is not None and matrix.shape[1] != dim)):
        raise ValueError(f"query vectors must all have dimension {dim or 'd'}")
    return typed_ids(rows, part), matrix.reshape(len(rows), -1)


def as_matrix(embedding, dim: int):
    """An Arrow list column as a float64 matrix; a vector of another length is an error."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.list_value_length(embedding)
    if len(embedding) and pc.min_max(lengths).as_py() != {"min": dim, "max": dim}:
        raise ValueError(f"stored vectors must have dimension {dim}")
    return embedding.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def score_block(queries, stored, metric: str, digits: int | None = SCORE_DIGITS):
    """Scores of all queries against a block of stored vectors, rounded for stable ranks."""
    import numpy as np

    scores = queries @ stored.T
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(stored, axis=1))
        scores = np.divide(scores, norms, out=np.full_like(scores, -np.inf), where=norms > 0)
    elif metric == "l2":
        squares = (queries**2).sum(axis=1)[:, None] + (stored**2).sum(axis=1)[None, :]
        scores = -np.sqrt(np.maximum(squares - 2 * scores, 0))
    return scores if digits is None else np.round(scores, digits)


def _score_task(query_ids, queries, k, id_col, facet_col, metric):
    def run(batches):
        best, schema = TaskTopK(len(query_ids), k), None
        for whole in batches:
            schema = whole.schema
            if not len(query_ids):
                continue
            for batch in blocks(whole, len(query_ids)):
                stored = as_matrix(batch.column("embedding"), queries.shape[1])
                best.offer(score_block(queries, stored, metric).T, batch.column(id_col), facets_of(batch, facet_col))
        if schema is not None:
            yield candidate_batch(best, query_ids, schema, id_col, facet_col)

    return run
