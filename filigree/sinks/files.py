"""Sinks for raw filings, manifests and corpus tables."""
from __future__ import annotations

from pyspark.sql import DataFrame

from filigree.operators.manifest import manifest_header
from filigree.schemas import MANIFEST_COLUMNS
from filigree.sources.parameters import Selection


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), clear: bool = True) -> None:
    """Overwrite (or with `clear=False` append to) a Parquet table."""
    writer = df.write.mode("overwrite" if clear else "append").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_raw_table(filings: DataFrame, path: str, clear: bool = True) -> None:
    """Raw filings `(year, local_path, content)` as a table in year folders."""
    write_table(filings.select("year", "local_path", "content"), path, partition_by=("year",), clear=clear)


def export_raw_files(filings: DataFrame, base_uri: str) -> DataFrame:
    """Write each row's `content` to `<base_uri>/<local_path>`; returns `(local_path, bytes)`.

    A path is written whole and again with the same bytes if its task is retried.
    """

    def run(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)
        for batch in batches:
            paths, sizes = batch.column("local_path").to_pylist(), []
            for i, path in enumerate(paths):
                body = batch.column("content")[i].as_py()
                target = posixpath.join(root, path)
                store.create_dir(posixpath.dirname(target), recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(body)
                sizes.append(len(body))
            yield pa.RecordBatch.from_pydict({"local_path": paths, "bytes": pa.array(sizes, pa.int64())})

    return filings.select("local_path", "content").mapInArrow(run, "local_path string, bytes long")


def write_manifest(rows: DataFrame, order: list[str], path: str, selection: Selection = Selection()) -> DataFrame:
    """Write the manifest, its header last as the mark of a complete run, and return its rows.

    The layout is the same at every size: `<path>/filings` holds the filings in order as
    JSON lines, `<path>/header` one JSON object.
    """
    rows.orderBy(*order).select(*MANIFEST_COLUMNS).write.mode("overwrite").json(f"{path}/filings")
    manifest_header(rows, selection).coalesce(1).write.mode("overwrite").json(f"{path}/header")
    return rows


def clear_folder(base_uri: str) -> None:
    """Empty the target of a run, as an overwriting table write does."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(base_uri)
    store.delete_dir_contents(root, missing_dir_ok=True)
