"""Year-over-year comparison of filings, section by section."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.html import sections
from filigree.operators.comparison import passage_changes

SERIES = ["ticker", "filing_type", "section"]
PARAGRAPH_BREAK = r"\n[ \t]*\n\s*"


def section_versions(documents: DataFrame) -> DataFrame:
    """`(ticker, filing_type, section, year, passages)` of source documents.

    Parts of a year's documents with the same heading are one section, in document and page
    order; what stands before the first heading is the section ``.
    """
    parts = documents.select("ticker", "filing_type", "year", "document_id", F.inline(sections(F.col("markdown"))))
    named = F.lower(F.coalesce("section", F.lit(""))).alias("section")
    placed = F.struct("document_id", "section_index", "text")
    grouped = parts.select("ticker", "filing_type", named, "year", placed.alias("part")).groupBy(*SERIES, "year")
    whole = grouped.agg(F.array_sort(F.collect_list("part")).alias("parts"))
    passages = F.flatten(F.transform("parts", lambda p: F.split(p["text"], PARAGRAPH_BREAK)))
    return whole.select(*SERIES, "year", passages.alias("passages"))


def year_over_year(documents: DataFrame) -> DataFrame:
    """The changes of each section from a year's filings to those of the next year present,
    with both texts."""
    versions = section_versions(documents)
    changes = passage_changes(versions, SERIES, "year")
    texts = versions.select(*SERIES, "year", F.posexplode("passages").alias("index", "text"))

    def side(name: str) -> DataFrame:
        return texts.withColumnsRenamed({"year": f"{name}_year", "index": f"{name}_index", "text": f"{name}_text"})

    for name in ("old", "new"):
        changes = changes.join(side(name), [*SERIES, f"{name}_year", f"{name}_index"], "left")
    return changes
