"""Selecting each company's filings from its submission pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.filing_paths import fiscal_year
from filigree.operators.topk import top_k
from filigree.sources.parameters import Selection

BLOCK_FIELDS = ("form", "accessionNumber", "primaryDocument", "filingDate", "reportDate")
NEWEST_FIRST = ("page_ord", "row_ord")


def extract_filings(pages: DataFrame, block: str = "block") -> DataFrame:
    """One row per filing of columnar `block`, in array order; arrays of unequal length fail."""
    columns = [F.col(f"{block}.{f}") for f in BLOCK_FIELDS]
    sizes = [F.size(c) for c in columns]
    equal = F.least(*sizes) == F.greatest(*sizes)
    zipped = F.arrays_zip(*columns)
    checked = F.when(equal & (sizes[0] >= 0), zipped).otherwise(
        F.raise_error(F.lit("submission columns differ in length")).cast(
            "array<struct<" + ",".join(f"{f}:string" for f in BLOCK_FIELDS) + ">>"
        )
    )
    others = [c for c in pages.columns if c != block]
    rows = pages.select(*others, F.posexplode(checked).alias("row_ord", "f"))
    return rows.select(
        *others,
        "row_ord",
        fiscal_year(F.col("f.reportDate"), F.col("f.filingDate")).alias("year"),
        F.col("f.form").alias("form"),
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
        F.col("f.filingDate").alias("filing_date"),
        F.col("f.reportDate").alias("report_date"),
    )


def is_annual(selection: Selection) -> Column:
    return F.col("form").isin(*selection.annual_forms) & F.col("year").isin(*selection.years())


def newest(order: tuple[str, ...] = NEWEST_FIRST) -> list[Column]:
    """Latest filing date first (ISO strings), ties in page and row order."""
    return [F.desc("filing_date"), *[F.asc(c) for c in order]]


def select_annual(filings: DataFrame, selection: Selection = Selection(), key: str = "ticker") -> DataFrame:
    """The newest annual filings of the year window per company, adding `rank`."""
    return top_k(filings.where(is_annual(selection)), [key], newest(), selection.per_company)


def select_fallback(filings: DataFrame, selection: Selection = Selection(), key: str = "ticker") -> DataFrame:
    """The newest filing of each fallback form per company, in any year, adding `form_ord`."""
    rows = filings.where(F.col("form").isin(*selection.fallback_forms))
    rows = rows.withColumn("form_ord", _form_order(selection))
    return top_k(rows, [key, "form"], newest(), 1).drop("rank")


def select_filings(filings: DataFrame, selection: Selection = Selection(), key: str = "ticker") -> DataFrame:
    """Annual filings per company, or the fallback forms where it has none, adding `rank`.

    One scan serves both branches. Each task cuts a company's rows to a handful before
    the shuffle, so a company with most of the rows costs no more than another.
    """
    branch = F.when(is_annual(selection), F.lit("annual")).when(
        F.col("form").isin(*selection.fallback_forms), F.col("form")
    )
    rows = filings.withColumn("_branch", branch).where(F.col("_branch").isNotNull())
    if selection.dedupe:
        rows = top_k(rows, [key, "accession_number"], [F.asc(c) for c in NEWEST_FIRST], 1).drop("rank")
    annual = F.col("_branch") == "annual"
    few = top_k(rows, [key, "_branch"], newest(), selection.per_company, "_n")
    few = few.where(annual | (F.col("_n") == 1))
    few = few.withColumn("_has_annual", F.max(annual).over(Window.partitionBy(key)))
    few = few.where(annual == F.col("_has_annual"))
    order = F.when(annual, F.lit(0)).otherwise(_form_order(selection))
    window = Window.partitionBy(key).orderBy(F.desc("filing_date"), order, *NEWEST_FIRST)
    return few.withColumn("rank", F.row_number().over(window)).drop("_branch", "_n", "_has_annual")


def _form_order(selection: Selection) -> Column:
    forms = F.array(*[F.lit(f) for f in selection.fallback_forms])
    return F.array_position(forms, F.col("form")).cast("int")
