"""Parameter relations of the filing selection, each with its order kept as a column."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tickers in order, their CIK numbers, and the accepted forms in order.
TICKERS = ("AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "BSP")
COMPANY_CIKS = {
    "AAPL": "0000320193",
    "MSFT": "0000789019",
    "NVDA": "0001045810",
    "AMZN": "0001018724",
    "GOOGL": "0001652044",
    "BSP": "0002004711",
}
ANNUAL_FORMS = ("10-K", "20-F")
FALLBACK_FORMS = ("F-1", "S-1", "424B4")
FILINGS_PER_COMPANY = 5


@dataclass(frozen=True)
class Selection:
    """What to select: how many filings and years per company, of which forms, as of when."""

    per_company: int = FILINGS_PER_COMPANY
    annual_forms: tuple[str, ...] = ANNUAL_FORMS
    fallback_forms: tuple[str, ...] = FALLBACK_FORMS
    as_of: date | None = None
    dedupe: bool = False

    def years(self) -> list[str]:
        """The `per_company` calendar years before the current one."""
        now = (self.as_of or datetime.now(UTC)).year
        return [str(y) for y in range(now - self.per_company, now)]


def tickers(spark: SparkSession, names=TICKERS, ciks: dict[str, str] = COMPANY_CIKS) -> DataFrame:
    """`(ticker, cik, ticker_ord)`; reading a ticker without a CIK fails the query."""
    listed = spark.createDataFrame(list(enumerate(names)), "ticker_ord int, ticker string")
    known = spark.createDataFrame(list(ciks.items()), "ticker string, cik string")
    missing = F.raise_error(F.concat(F.lit("no CIK for ticker "), F.col("ticker")))
    return listed.join(known, "ticker", "left").select(
        "ticker", F.coalesce("cik", missing.cast("string")).alias("cik"), "ticker_ord"
    )
