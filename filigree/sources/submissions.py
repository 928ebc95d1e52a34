"""Landed submission pages: primary page, then its continuation pages in order."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.schemas import SUBMISSION_BLOCK, SUBMISSION_PAGE


def read_pages(spark: SparkSession, directory: str) -> DataFrame:
    """`(file_name, filings, form, accessionNumber, ...)`, one row per JSON file."""
    pages = spark.read.schema(SUBMISSION_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(directory)
    return pages.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), "*")


def parse_pages(fetched: DataFrame) -> DataFrame:
    """The relation of `read_pages` from fetched `(file_name, json)`."""
    page = F.from_json("json", SUBMISSION_PAGE, {"mode": "FAILFAST"})
    return fetched.select("file_name", page.alias("p")).select("file_name", "p.*")


def page_blocks(pages: DataFrame) -> DataFrame:
    """`(cik, page_ord, block)`: the primary page's recent filings, then each listed page.

    A primary page without recent filings, or a listed page that was not landed, fails.
    """
    primary = pages.where(F.col("filings").isNotNull()).select(
        F.regexp_extract("file_name", r"CIK(\d+)\.json$", 1).alias("cik"),
        F.lit(0).alias("page_ord"),
        F.coalesce(
            "filings.recent", F.raise_error(F.lit("page without recent filings")).cast(SUBMISSION_BLOCK)
        ).alias("block"),
        F.coalesce("filings.files", F.array().cast("array<struct<name:string>>")).alias("files"),
    )
    listed = primary.select("cik", F.posexplode("files").alias("pos", "file")).select(
        "cik", (F.col("pos") + 1).alias("page_ord"), F.col("file.name").alias("file_name")
    )
    bare = pages.where(F.col("filings").isNull()).select(
        "file_name", F.struct(*SUBMISSION_BLOCK.names).alias("block")
    )
    missing = F.raise_error(F.concat(F.lit("page not landed: "), F.col("file_name")))
    continued = listed.join(bare, "file_name", "left").select(
        "cik", "page_ord", F.coalesce("block", missing.cast(SUBMISSION_BLOCK)).alias("block")
    )
    return primary.drop("files").unionByName(continued)
