"""The retrieval tools over a stored corpus: search, read a chunk, read around it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.embedding import Embedder, embed_column
from filigree.operators import context
from filigree.operators.balance import balanced_top_k, facet_key
from filigree.operators.fusion import fused, reciprocal_rank_fusion
from filigree.operators.lexical import lexical_search
from filigree.operators.retrieval import FINAL_K, LIST_DEPTH
from filigree.operators.semantic import semantic_search

CHUNK = "chunk_id"


class CorpusTools:
    """Bounded tools over `<path>/document_chunks`; callers pass values, never SQL text."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder):
        self.chunks = spark.read.parquet(f"{path}/document_chunks")
        self.embedder = embedder

    def restrict(
        self, tickers: list[str] | None = None, years: list[int] | None = None, filing_types: list[str] | None = None
    ) -> Column:
        """A metadata filter; years prune partitions of the stored table."""
        where = F.lit(True)
        for column, values in (("metadata.ticker", tickers), ("year", years), ("metadata.filing_type", filing_types)):
            if values is not None:
                where = where & F.col(column).isin(values)
        return where

    def search_filings(
        self, queries: DataFrame, k: int = FINAL_K, *, where: Column | None = None, balance: str | list[str] | None = None
    ) -> DataFrame:
        """Hybrid search for `(query_id, text)`: fused hits with passage and metadata.

        `balance` names a metadata field or several, e.g. `["ticker", "year"]`; each list
        then takes its depth per combination of their values, and each combination keeps
        its share of the `k` hits, so no company or year crowds out the others.
        """
        rows = self.chunks if where is None else self.chunks.where(where)
        if balance:
            fields = [balance] if isinstance(balance, str) else balance
            rows = rows.withColumn("_facet", facet_key([f"metadata.{f}" for f in fields]))
        facet = "_facet" if balance else None
        asked = embed_column(queries.select("query_id", "text"), self.embedder)
        lists = {
            "lexical": lexical_search(rows, queries, LIST_DEPTH, id_col=CHUNK, facet_col=facet, corpus=self.chunks),
            "semantic": semantic_search(rows, asked, LIST_DEPTH, id_col=CHUNK, facet_col=facet, dim=self.embedder.dim),
        }
        if balance:
            hits = balanced_top_k(fused(lists, id_col=CHUNK, keep=("_facet",)), "_facet", k, id_col=CHUNK).drop("_facet", "turn")
        else:
            hits = reciprocal_rank_fusion(lists, k, id_col=CHUNK)
        shown = self.chunks.select(CHUNK, "document_id", "chunk_index", "page", "section", "text", "metadata")
        found = context.attach(hits, shown, CHUNK, k * queries.count())
        return found.withColumn("excerpt", context.excerpt(F.col("text")))

    def read_chunk(self, chunk_id: str) -> DataFrame:
        return context.read_chunk(self.chunks, chunk_id)

    def read_surrounding_chunks(self, hits: DataFrame, width: int = context.NEIGHBOURS) -> DataFrame:
        """Neighbours of `(document_id, chunk_index, ...)` hits."""
        shown = self.chunks.select(CHUNK, "document_id", "chunk_index", "page", "section", "text")
        return context.surrounding_chunks(hits, shown, width=width)
