"""The manifest of selected filings: its rows and its header."""
from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.filing_paths import ARCHIVE_URL, local_path, source_url
from filigree.schemas import MANIFEST_COLUMNS
from filigree.sources.parameters import Selection

# Fixed value of the manifest format.
SOURCE_NAME = "SEC EDGAR"


def manifest_rows(selected: DataFrame, order: list[str], archive_url: str = ARCHIVE_URL) -> DataFrame:
    """The nine manifest columns plus the columns that order them."""
    url = source_url(F.col("cik"), F.col("accession_number"), F.col("primary_document"), archive_url)
    path = local_path(*[F.col(c) for c in
                        ("year", "ticker", "form", "filing_date", "accession_number", "primary_document")])
    rows = selected.withColumn("source_url", url).withColumn("local_path", path)
    return rows.select(*order, *[c for c in MANIFEST_COLUMNS if c not in order])


def manifest_header(rows: DataFrame, selection: Selection = Selection(), as_of: datetime | None = None) -> DataFrame:
    """One row: source, time, forms and count; the filings themselves stay rows."""
    generated = F.lit(as_of.astimezone(UTC).isoformat()) if as_of else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
    )
    return rows.agg(F.count(F.lit(1)).alias("downloaded_count")).select(
        F.lit(SOURCE_NAME).alias("source"),
        generated.alias("generated_at_utc"),
        F.array(*[F.lit(f) for f in selection.annual_forms]).alias("annual_forms"),
        F.array(*[F.lit(f) for f in selection.fallback_forms]).alias("fallback_forms"),
        "downloaded_count",
    )
