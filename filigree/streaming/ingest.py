"""Incremental ingestion: new texts become chunks once, also after a restart."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.bounded import broadcast_if_small
from filigree.operators.chunking import CHUNK_STRIDE, CHUNK_TOKENS, chunk_documents


def ingest_available(
    arriving: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
) -> None:
    """Process everything available in the stream `arriving`, then stop.

    Each micro-batch overwrites its own `batch` partition, so a batch that runs again
    after a failure replaces what it wrote before; nothing stored earlier is rewritten. A
    document that comes twice in a batch counts once (of different texts, the one with the
    greatest hash). Progress is kept in `<path>/checkpoint`.
    """

    def store(rows: DataFrame, batch: int) -> None:
        once = rows.groupBy(id_col).agg(F.max_by(text_col, F.xxhash64(text_col)).alias(text_col))
        chunks = chunk_documents(once, id_col=id_col, text_col=text_col, size=size, stride=stride)
        _replace(chunks, f"{path}/chunks", batch)

    query = (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _replace(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored_chunks(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """All ingested chunks; a document that arrived again counts as its newest version."""
    chunks = spark.read.parquet(f"{path}/chunks")
    batches = chunks.groupBy(F.col(id_col).alias("_id")).agg(F.max("batch").alias("_newest"), F.min("batch").alias("_oldest"))
    # Only documents that came more than once have chunks to leave out.
    again = broadcast_if_small(batches.where(F.col("_newest") > F.col("_oldest")))
    stale = (chunks[id_col] == F.col("_id")) & (chunks["batch"] < F.col("_newest"))
    return chunks.join(again, stale, "left_anti").drop("batch")
