"""The given Parquet tables, and the domain relations read from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.bounded import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs, "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the stored vector of the same id."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    stored = vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return stored.join(items, "query_id")
