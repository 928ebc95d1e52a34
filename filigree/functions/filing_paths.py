"""Column expressions for filing years, source URLs and local names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data"
DEFAULT_SUFFIX = ".html"


def fiscal_year(report_date: Column, filing_date: Column) -> Column:
    """Year of the report date, or of the filing date when that is absent or empty."""
    return F.substring(F.coalesce(F.nullif(report_date, F.lit("")), filing_date), 1, 4)


def suffix(name: Column) -> Column:
    """Last `.ext` of the final path component; empty without one."""
    return F.regexp_extract(name, r"^(?:.*/)?[^/]+?(\.[^./]+)$", 1)


def source_url(
    cik: Column, accession_number: Column, primary_document: Column, base: str = ARCHIVE_URL
) -> Column:
    number = cik.cast("bigint").cast("string")
    return F.concat_ws(
        "/", F.lit(base), number, F.replace(accession_number, F.lit("-"), F.lit("")), primary_document
    )


def local_path(
    year: Column, ticker: Column, form: Column, filing_date: Column, accession_number: Column, primary_document: Column
) -> Column:
    stem = F.concat_ws("_", F.lower(ticker), F.lower(form), filing_date, accession_number)
    ending = F.coalesce(F.nullif(suffix(primary_document), F.lit("")), F.lit(DEFAULT_SUFFIX))
    return F.concat(year, F.lit("/"), stem, ending)
