"""Size checks in front of everything that is broadcast or brought to the driver."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from filigree.session import shared_dir, stored

BROADCAST_ROWS = 200_000
QUERY_SLICE = 8192
#: A table of so many splits is never shuffled to spread it.
SMALL_SPLITS = 8


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the row count is within bounds, else a plain shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than there are cores.

    Only inputs of a few splits, up to a gigabyte or so, are shuffled; a larger table is
    returned as it is, however many cores there are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= min(cores, SMALL_SPLITS) else rows.repartition(cores, key)


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row]:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    salt_by: list[str],
    how: str = "left",
    salts: int = 16,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many facts to a lookup that is unique per `key`, whatever the key's skew.

    A lookup within bounds is broadcast. A larger one is repeated once per salt, and
    the facts of one key are spread over the salts.
    """
    if fits(lookup, max_rows):
        return facts.join(F.broadcast(lookup), key, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def in_query_slices(
    queries: DataFrame,
    search: Callable[[DataFrame, DataFrame], DataFrame],
    max_rows: int = QUERY_SLICE,
    load: Column | None = None,
) -> DataFrame:
    """Run `search` on slices of the query set small enough to ship to every task.

    `search` gets a slice and the whole set, as it is stored for several slices. The
    slices hold about `max_rows` queries; `load`, an aggregate of the whole set, may ask
    for more slices. Queries are dealt by a hash of all their columns. One slice, which is
    the whole set, stays lazy; several are a job each that appends to a shared table, so
    neither the plan nor the driver grows with them.
    """
    slices, held = queries.count() / max_rows, queries
    if slices > 1:
        held = stored(queries, "queries")
    if load is not None:
        slices = max(slices, held.agg(load).first()[0] or 0)
    slices = math.ceil(slices)
    if slices <= 1:
        return search(queries, queries)
    if held is queries:
        held = stored(queries, "queries")
    spark = queries.sparkSession
    path = shared_dir(spark, "query-slices")
    bucket = F.pmod(F.xxhash64(*held.columns), F.lit(slices))
    for i in range(slices):
        part = search(held.where(bucket == i), held)
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)
