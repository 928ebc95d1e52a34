"""From raw HTML filings to source documents, passages, vectors and postings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.embedding import Embedder, embed_column
from filigree.functions.html import markdown, sections
from filigree.operators.bounded import lookup_join
from filigree.operators.chunking import CHUNK_STRIDE, CHUNK_TOKENS, chunk_sections
from filigree.operators.incremental import content_hash, update_tables
from filigree.schemas import CHUNK_METADATA, SOURCE_DOCUMENTS
from filigree.sinks.files import write_table

METADATA = ["ticker", "company", "filing_type", "filing_date", "year", "accession_number"]


def source_documents(raw: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Raw files `(local_path, html)` with their manifest rows, HTML as Markdown.

    `filings` is unique by `local_path`, `companies` `(ticker, company)` by ticker.
    """
    joined = raw.select("local_path", "html").join(filings, "local_path")
    named = lookup_join(joined, companies, "ticker", ["local_path"])
    return named.select(
        F.col("accession_number").alias("document_id"),
        "ticker",
        "company",
        F.col("form").alias("filing_type"),
        F.to_date("filing_date").alias("filing_date"),
        F.split("local_path", "/")[0].cast("int").alias("year"),
        "accession_number",
        "source_url",
        markdown(F.col("html")).alias("markdown"),
    ).to(SOURCE_DOCUMENTS)


def chunk_metadata() -> Column:
    return F.struct(
        *METADATA, "page", "section", F.struct("start", "end").alias("offsets")
    ).cast(CHUNK_METADATA)


def document_chunks(
    documents: DataFrame, *, size: int = CHUNK_TOKENS, stride: int = CHUNK_STRIDE
) -> DataFrame:
    """Passages of source documents with page, section and metadata. No shuffle."""
    cut = documents.withColumn("sections", sections(F.col("markdown"))).drop("markdown")
    chunks = chunk_sections(cut, size=size, stride=stride, keep=METADATA)
    return chunks.select(
        "chunk_id", "document_id", "chunk_index", "page", "section", "text", "token_count",
        chunk_metadata().alias("metadata"),
    )


def update_corpus(
    documents: DataFrame, embedder: Embedder, path: str, *, complete: bool = False, size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
) -> dict[str, int]:
    """Add or replace source documents; only those that are new or changed are chunked and
    embedded, and only the year folders they are in (or were in) are rewritten. With
    `complete`, documents that don't come any more are removed. Returns the counts."""

    def derive(rows: DataFrame) -> DataFrame:
        chunks = embed_column(document_chunks(rows, size=size, stride=stride), embedder)
        return chunks.withColumn("year", F.col("metadata.year"))

    return update_tables(
        documents.to(SOURCE_DOCUMENTS), path, derive, id_col="document_id", partition="year",
        documents="source_documents", derived="document_chunks", complete=complete,
    )


def store_corpus(
    documents: DataFrame, embedder: Embedder, path: str, *, clear: bool = True, size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
) -> None:
    """Write `<path>/source_documents`, then `<path>/document_chunks` read from the former.

    Without `clear`, the documents are added to what is stored.
    """
    if not clear:
        update_corpus(documents, embedder, path, size=size, stride=stride)
        return
    spark = documents.sparkSession
    columns = documents.to(SOURCE_DOCUMENTS).columns
    hashed = documents.to(SOURCE_DOCUMENTS).withColumn("content_hash", content_hash(columns)).withColumn("generation", F.lit(1))
    write_table(hashed, f"{path}/source_documents", partition_by=("year",))
    kept = spark.read.schema(hashed.schema).parquet(f"{path}/source_documents").select(*columns)
    chunks = embed_column(document_chunks(kept, size=size, stride=stride), embedder)
    chunks = chunks.withColumn("year", F.col("metadata.year")).withColumn("generation", F.lit(1))
    write_table(chunks, f"{path}/document_chunks", partition_by=("year",))
