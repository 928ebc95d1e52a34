"""Domain relations derived from the given tables."""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.operators.chats import turn_pairs
from filigree.schemas import SUBMISSION_BLOCK
from filigree.sources.parameters import Selection
from filigree.sources.tables import table

PAGE_FILINGS = 1000
SELECTION = Selection(as_of=date(2000, 6, 1))
# Order priorities standing for filing forms, statuses for file suffixes.
PRIORITY_FORMS = {
    "1-URGENT": "10-K", "2-HIGH": "20-F", "3-MEDIUM": "F-1", "4-NOT SPECIFIED": "S-1", "5-LOW": "424B4",
}
STATUS_SUFFIXES = {"F": ".htm", "O": ".txt", "P": ""}


def _choose(column: str, values: dict[str, str], default: str):
    chosen = F.lit(default)
    for key, value in values.items():
        chosen = F.when(F.col(column) == key, value).otherwise(chosen)
    return chosen


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: the customer is the company, the priority the form."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    report = F.when(F.col("o_orderstatus") == "P", "").otherwise(
        F.date_format(F.date_sub(F.to_date("o_orderdate"), 90), "yyyy-MM-dd")
    )
    cik = F.format_string("%010d", "o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"),
        cik.alias("cik"),
        F.floor(F.col("o_orderkey") / PAGE_FILINGS).cast("int").alias("page_ord"),
        "o_orderkey",
        _choose("o_orderpriority", PRIORITY_FORMS, "8-K").alias("form"),
        F.concat(cik, F.lit("-"), F.substring(day, 3, 2), F.lit("-"), F.format_string("%06d", "o_orderkey")).alias(
            "accessionNumber"
        ),
        F.concat(F.lit("d"), "o_orderkey", _choose("o_orderstatus", STATUS_SUFFIXES, "")).alias("primaryDocument"),
        day.alias("filingDate"),
        report.alias("reportDate"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filings in the columnar form of submission pages: `(ticker, cik, page_ord, block)`.

    Order keys are unique, so a page holds at most `PAGE_FILINGS` of them, whichever
    company they belong to.
    """
    fields = SUBMISSION_BLOCK.names
    entry = F.struct("o_orderkey", *fields)
    pages = order_filings(spark, sf_dir).groupBy("ticker", "cik", "page_ord").agg(
        F.array_sort(F.collect_list(entry)).alias("e")
    )
    # A field of an array of structs is the array of that field.
    block = F.struct(*[F.col(f"e.{f}").alias(f) for f in fields])
    return pages.select("ticker", "cik", "page_ord", block.alias("block"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as fetched files `(file_name, json)`: a company's first page nested
    with the names of the others, which hold their columns at the root."""
    nth = F.row_number().over(Window.partitionBy("cik").orderBy("page_ord")) - 1
    pages = order_pages(spark, sf_dir).withColumn("n", nth)
    own = F.concat(F.lit("CIK"), "cik", F.when(F.col("n") > 0, F.format_string("-submissions-%03d", "n")).otherwise(F.lit("")), F.lit(".json"))
    pages = pages.withColumn("file_name", own)
    listed = pages.where("n > 0").groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("n", "file_name"))).alias("names"))
    files = F.transform("names", lambda x: F.struct(x["file_name"].alias("name")))
    nested = F.to_json(F.struct(F.struct(F.col("block").alias("recent"), files.alias("files")).alias("filings")))
    first = pages.where("n = 0").join(listed, "cik", "left").select("file_name", nested.alias("json"))
    return first.unionByName(pages.where("n > 0").select("file_name", F.to_json("block").alias("json")))


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(ticker, cik)`: customers, and suppliers, who share the CIK of the customer of their number."""
    names = [("C", "o_custkey", table(spark, sf_dir, "orders")), ("S", "s_suppkey", table(spark, sf_dir, "supplier"))]
    customers, suppliers = (
        rows.select(F.concat(F.lit(letter), key).alias("ticker"), F.format_string("%010d", key).alias("cik")).distinct()
        for letter, key, rows in names
    )
    return customers.unionByName(suppliers)


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stored messages, timed by the event of the same number.

    Message `turn` of conversation c takes the time of event 8c + turn; the thread's
    owner is the user of event 8c. Messages without an event keep null times.
    """
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"),
        F.col("turn").alias("ordinal"),
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        "role",
        "text",
        (F.col("conv_id") * 8 + F.col("turn")).alias("event_id"),
    )
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id"), F.col("ts").alias("created_at"), "event_type"
    )
    return said.join(events, "event_id", "left")


def question_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(turn_id, question, answer)` for each answered user message."""
    messages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("ordinal"), "role", "text"
    )
    return turn_pairs(messages).select(
        F.concat_ws("-", "thread_id", "ordinal").alias("turn_id"), "question", "answer"
    )
