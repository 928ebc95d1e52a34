"""Reciprocal rank fusion of any number of ranked lists."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.topk import best_first, top_k

RRF_K = 60  # Cormack, Clarke and Buettcher, SIGIR 2009


def fused(lists: dict[str, DataFrame], *, id_col: str = "doc_id", constant: int = RRF_K, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sum `1 / (constant + rank)` over the named lists, of every document in any of them.

    Gives `(query_id, id, *keep, rrf_score, <name>_rank...)`, a list's rank being 0 where it
    lacks the document; `keep` are columns of the lists that go with the id. The lists are
    unioned and summed in one aggregation, however many there are.
    """
    ranked = reduce(
        DataFrame.unionByName,
        [x.select("query_id", id_col, *keep, "rank", F.lit(name).alias("_list")) for name, x in lists.items()],
    )
    in_list = {name: F.max(F.when(F.col("_list") == name, F.col("rank")).otherwise(0)) for name in lists}
    own = [rank.alias(f"{name}_rank") for name, rank in in_list.items()]
    return ranked.groupBy("query_id", id_col, *keep).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 12).alias("rrf_score"), *own
    )


def reciprocal_rank_fusion(
    lists: dict[str, DataFrame], k: int, *, id_col: str = "doc_id", constant: int = RRF_K
) -> DataFrame:
    """The `k` best of the fused lists per query, with their `rank`."""
    return top_k(fused(lists, id_col=id_col, constant=constant), ["query_id"], best_first("rrf_score", id_col), k)
