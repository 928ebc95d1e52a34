"""Raw filings: landed files, and fetching by URL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_ACCEPT = "application/json"
DOCUMENT_ACCEPT = "text/html,application/xhtml+xml,application/xml"


def read_raw_files(spark: SparkSession, directory: str) -> DataFrame:
    """`(local_path, year, html)` of every landed file below `<directory>/<year>/`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(_relative(F.col("path")).alias("local_path"), *_content())


def stream_raw_files(spark: SparkSession, directory: str) -> DataFrame:
    """The same relation as a stream over newly landed files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(_relative(F.col("path")).alias("local_path"), *_content())


def _relative(path):
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))


def _content():
    return (
        F.element_at(F.split("path", "/"), -2).alias("year"),
        F.decode("content", "UTF-8").alias("html"),
    )


def fetch(
    urls: DataFrame,
    *,
    user_agent: str,
    accept: str = DOCUMENT_ACCEPT,
    timeout: float = 60,
    pause: float = 0.2,
    concurrency: int = 1,
) -> DataFrame:
    """Add `content binary` by fetching the column `url`; an error fails the job, without retry here.

    Sources ask for slow sequential access, so one task fetches unless `concurrency`
    says otherwise, pausing after every request. Rows stream through; none are held.
    """
    names = urls.columns

    def run(batches):
        import time
        from urllib import request

        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                asked = request.Request(
                    row.column("url")[0].as_py(), headers={"Accept": accept, "User-Agent": user_agent}
                )
                with request.urlopen(asked, timeout=timeout) as response:
                    body = response.read()
                time.sleep(pause)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([body], pa.binary())], names=[*names, "content"]
                )

    schema = T.StructType([*urls.schema, T.StructField("content", T.BinaryType())])
    return urls.repartition(concurrency).mapInArrow(run, schema)


def fetch_json(urls: DataFrame, *, user_agent: str, timeout: float = 30) -> DataFrame:
    """Submission pages as `json string`, fetched without a pause."""
    pages = fetch(urls, user_agent=user_agent, accept=JSON_ACCEPT, timeout=timeout, pause=0)
    return pages.withColumn("json", F.decode("content", "UTF-8")).drop("content")
