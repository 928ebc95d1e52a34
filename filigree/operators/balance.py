"""A fair share of the results for each value, or combination of values, of some facets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.topk import best_first, top_k

SEPARATOR = "\x1f"


def facet_key(facets: list[str]) -> Column:
    """Several facets as one value; an absent one counts as empty."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in facets])


def balanced_top_k(candidates: DataFrame, facet: str, k: int, *, id_col: str = "doc_id", score: str = "rrf_score") -> DataFrame:
    """`k` of the candidates per query, in turns: the best of every facet value, the second
    best of every one, and so on, each turn in order of score; adds `turn` and `rank`.

    So no value has two results more than another that still has candidates, and what a
    value can't fill goes to the others. Tasks cut to `k` per query and value before the
    shuffle.
    """
    turns = top_k(candidates, ["query_id", facet], best_first(score, id_col), k, "turn")
    return top_k(turns, ["query_id"], [F.asc("turn"), *best_first(score, id_col)], k)
