"""The whole filing run: submission pages, selection, raw files, then the manifest."""
from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filigree.functions.filing_paths import ARCHIVE_URL
from filigree.operators.filings import extract_filings, select_filings
from filigree.operators.manifest import manifest_rows
from filigree.session import shared_dir, stored
from filigree.sinks.files import clear_folder, write_manifest
from filigree.sources.parameters import COMPANY_CIKS, TICKERS, Selection, tickers
from filigree.sources.raw_files import JSON_ACCEPT
from filigree.sources.submissions import page_blocks, parse_pages, read_pages
from filigree.sources.url_source import landed

SUBMISSIONS_URL = "https://data.sec.gov/submissions"
ORDER = ["ticker_ord", "rank"]
log = logging.getLogger(__name__)


def fetch_pages(companies: DataFrame, user_agent: str, base: str = SUBMISSIONS_URL, landing: str | None = None) -> DataFrame:
    """Primary pages of the companies, then the pages they list; every page fetched once.

    Companies that share a CIK share its pages. Pages are landed in the folder `landing`;
    one that is there already is not asked for again.
    """
    spark = companies.sparkSession
    landing = landing or shared_dir(spark, "pages")

    def pages(names: DataFrame, folder: str) -> DataFrame:
        urls = names.distinct().select(F.col("file_name").alias("local_path"), F.concat(F.lit(f"{base}/"), "file_name").alias("url"))
        found = landed(urls, f"{landing}/{folder}", user_agent=user_agent, accept=JSON_ACCEPT, timeout=30, pause=0)
        if not stored(found, "landed").isEmpty():
            return read_pages(spark, f"{landing}/{folder}")
        return parse_pages(spark.createDataFrame([], "file_name string, json string"))

    primary = pages(companies.select(F.concat(F.lit("CIK"), "cik", F.lit(".json")).alias("file_name")), "primary")
    listed = primary.select(F.explode("filings.files.name").alias("file_name"))
    return primary.unionByName(pages(listed, "listed"))


def download_filings(
    spark: SparkSession,
    output: str,
    user_agent: str,
    *,
    names=TICKERS,
    ciks: dict[str, str] = COMPANY_CIKS,
    selection: Selection = Selection(),
    clear: bool = True,
    pause: float = 0.2,
    submissions_url: str = SUBMISSIONS_URL,
    archive_url: str = ARCHIVE_URL,
) -> DataFrame:
    """Fetch each company's selected filings to `<output>/<year>/`; returns the manifest rows.

    `<output>/manifest` is written last, so its presence marks a complete run. Without
    `clear`, a run after a failure fetches only the files not landed yet. What is logged is
    counted while the rows are written, without jobs of its own.
    """
    if clear:
        clear_folder(output)
    companies = tickers(spark, names, ciks)
    blocks = page_blocks(fetch_pages(companies, user_agent, submissions_url))
    filings = extract_filings(blocks.join(companies, "cik"))
    per_company = Observation("companies")
    rows = manifest_rows(select_filings(filings, selection), ORDER, archive_url)
    rows = stored(rows.observe(per_company, *[F.count_if(F.col("ticker") == name).alias(name) for name in names]), "manifest")
    for name in names:
        n = per_company.get[name]
        log.info("%s: %s", name, f"{n} filings" if n else "no supported filings")
    files = Observation("files")
    fetched = landed(rows.select("local_path", F.col("source_url").alias("url")), output, user_agent=user_agent, pause=pause)
    counted = (F.count(F.lit(1)).alias("files"), F.count_if("fetched").alias("fetched"))
    stored(fetched.observe(files, *counted), "landed")
    write_manifest(rows, ORDER, f"{output}/manifest", selection)
    log.info("downloaded %d filing(s), %d of them now, to %s", files.get["files"], files.get["fetched"], output)
    return rows
