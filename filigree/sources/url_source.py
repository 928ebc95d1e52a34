"""A Spark data source that lands files by URL: parallel by host, resumable.

`spark.read.format("landed_urls")` reads a manifest of URLs that Spark wrote in folders by
host and lane, and fetches what has not been landed yet. A partition is one lane of one
host; it asks for one file at a time and pauses after each. A file gets its name when it is
whole, so a run (or a task) that is repeated after a failure fetches only the rest.
"""
from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib import request

from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from filigree.session import shared_dir
from filigree.sources.raw_files import DOCUMENT_ACCEPT

LANDED_FIELDS = "local_path string, url string, bytes long, fetched boolean"


@dataclass
class Lane(InputPartition):
    """The manifest files of one lane of one host."""

    files: tuple[str, ...]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class LandedUrls(DataSource):
    """Options: `manifest` and `landing` (folders all executors reach), `userAgent`, `accept`,
    `timeout` and `pause` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "landed_urls"

    def schema(self) -> str:
        return LANDED_FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return LandedUrlsReader(self.options)


class LandedUrlsReader(DataSourceReader):
    def __init__(self, options):
        self.manifest, self.landing = options["manifest"], options["landing"]
        self.headers = {"Accept": options.get("accept", DOCUMENT_ACCEPT), "User-Agent": options["userAgent"]}
        self.timeout, self.pause = float(options.get("timeout", 60)), float(options.get("pause", 0.2))

    def partitions(self) -> list[Lane]:
        """One per folder that holds manifest files; their names are all that is listed here."""
        store, root = _store(self.manifest)
        lanes: dict[str, list[str]] = {}
        for found in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if found.type == fs.FileType.File and found.base_name.endswith(".parquet"):
                lanes.setdefault(posixpath.dirname(found.path), []).append(found.path)
        return [Lane(tuple(sorted(files))) for _, files in sorted(lanes.items())]

    def read(self, partition: Lane | None) -> Iterator[tuple]:
        if partition is None:  # an empty manifest
            return
        manifest, _ = _store(self.manifest)
        store, root = _store(self.landing)
        for path in partition.files:
            with manifest.open_input_file(path) as file:
                for batch in parquet.ParquetFile(file).iter_batches(columns=["url", "local_path"]):
                    for row in batch.to_pylist():
                        target = posixpath.join(root, row["local_path"])
                        found = store.get_file_info(target)
                        if found.type == fs.FileType.File:
                            yield row["local_path"], row["url"], found.size, False
                            continue
                        size = self._land(store, row["url"], target)
                        yield row["local_path"], row["url"], size, True
                        time.sleep(self.pause)

    def _land(self, store: fs.FileSystem, url: str, target: str) -> int:
        asked = request.Request(url, headers=self.headers)
        with request.urlopen(asked, timeout=self.timeout) as response:
            body = response.read()
        folder = posixpath.dirname(target)
        store.create_dir(folder, recursive=True)
        part = posixpath.join(folder, f".{posixpath.basename(target)}.{uuid.uuid4().hex}")
        with store.open_output_stream(part) as out:
            out.write(body)
        store.move(part, target)
        return len(body)


def landed(
    urls: DataFrame,
    landing: str,
    *,
    user_agent: str,
    accept: str = DOCUMENT_ACCEPT,
    timeout: float = 60,
    pause: float = 0.2,
    lanes: int = 1,
) -> DataFrame:
    """`(local_path, url, bytes, fetched)` of every row `(url, local_path)` of `urls`, landed at
    `<landing>/<local_path>`; `fetched` is false for files that were there already.

    Each host is asked by `lanes` tasks at a time. An error fails the job; what was landed
    stays. Reading the result again finds everything landed.
    """
    spark = urls.sparkSession
    host = F.coalesce(F.expr("parse_url(url, 'HOST')"), F.lit("local"))
    lane = F.pmod(F.xxhash64("local_path"), F.lit(lanes))
    manifest = shared_dir(spark, "urls")
    listed = urls.select("url", "local_path", host.alias("host"), lane.alias("lane")).dropDuplicates(["local_path"])
    listed.repartition("host", "lane").write.partitionBy("host", "lane").parquet(manifest)
    spark.dataSource.register(LandedUrls)
    options = {"manifest": manifest, "landing": landing, "userAgent": user_agent, "accept": accept, "timeout": str(timeout), "pause": str(pause)}
    return spark.read.format(LandedUrls.name()).options(**options).load()
