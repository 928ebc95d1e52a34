"""Keeping derived rows up with a corpus that changes: only what changed is derived again."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.operators.bounded import broadcast_if_small, collect_bounded
from filigree.session import CODEC, stored

#: Partition values that one update may touch.
MAX_PARTITIONS = 100_000
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def content_hash(columns: list[str]) -> Column:
    """Hash of the whole content of a row; an absent value differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _metrics(observation: Observation, otherwise: Callable[[], dict[str, int]]) -> dict[str, int]:
    """What was counted; a part of a plan that turns out empty may be cut with its counter."""
    try:
        return observation.get
    except Py4JJavaError:
        return otherwise()


def _within(column: str, values: list) -> Column:
    plain = [v for v in values if v is not None]
    found = F.col(column).isin(plain) if plain else F.lit(False)
    return found | F.col(column).isNull() if None in values else found


def _replace(path: str, before: DataFrame, gone: DataFrame, new: DataFrame, id_col: str, partition: str, touched: list, generation: int) -> None:
    """Rewrite the touched partitions of a table without the ids `gone` and with the rows `new`.

    An overwrite of single partitions is staged and moved when whole, so it may read the
    table it writes; nothing is written twice. It leaves partitions that have no rows any
    more as they are: those still hold ids of `gone` of an earlier generation.
    """
    spark = before.sparkSession
    kept = before.where(_within(partition, touched)).join(broadcast_if_small(gone), id_col, "left_anti") if generation > 1 else before
    rows = kept.unionByName(new)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy(partition).parquet(path)
    if generation == 1:
        return
    earlier = spark.read.schema(before.schema).parquet(path).where(_within(partition, touched) & (F.col("generation") < generation))
    stale = collect_bounded(earlier.join(gone, id_col, "left_semi").select(partition).distinct(), MAX_PARTITIONS)
    nothing = spark.createDataFrame([], T.StructType([f for f in before.schema if f.name != partition]))
    for (value,) in stale:
        folder = NULL_PARTITION if value is None else value
        nothing.write.mode("overwrite").parquet(f"{path}/{partition}={folder}")


def update_tables(
    arriving: DataFrame,
    path: str,
    derive: Callable[[DataFrame], DataFrame],
    *,
    id_col: str,
    partition: str,
    documents: str = "documents",
    derived: str = "chunks",
    complete: bool = False,
) -> dict[str, int]:
    """Bring `<path>/<documents>` and what `derive` makes of it in `<path>/<derived>` up to date.

    A row of `arriving` is left alone if the stored row of its id has the same content.
    New and changed ones are derived, and only the partitions that hold them, or held them
    before, are rewritten; with `complete`, stored ids that don't arrive are removed. Both
    tables carry the `generation` (number of the update) that wrote a row. Of several rows
    of one id the one with the greatest hash counts. Rows without id are left out.

    The documents are written last: an update that fails before is repeated as a whole.
    Returns how many documents were `added`, `changed`, `removed` and `unchanged`, and how
    many rows were `derived`, counted while writing.
    """
    spark = arriving.sparkSession
    columns = arriving.columns
    fields = [*arriving.schema.fields, T.StructField("content_hash", T.StringType()), T.StructField("generation", T.IntegerType())]
    before = read_if_present(spark, f"{path}/{documents}", T.StructType(fields))
    numbers = [t.select("generation") for t in (before, read_if_present(spark, f"{path}/{derived}", T.StructType(fields[-1:])))]
    # one more than any row's, also those of an update that failed
    generation = (reduce(DataFrame.unionByName, numbers).agg(F.max("generation")).first()[0] or 0) + 1

    hashed = arriving.where(F.col(id_col).isNotNull()).withColumn("content_hash", content_hash(columns))
    known = before.select(id_col, F.col("content_hash").alias("_before"), F.col(partition).alias("_partition"))
    told = hashed.join(known, id_col, "left")
    seen, wrote = Observation("arriving"), Observation("changed")
    same = F.col("content_hash").eqNullSafe(F.col("_before"))
    greatest = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("content_hash")))
    fresh = told.observe(seen, F.count_if(same).alias("unchanged")).where(~same).withColumn("_n", greatest).where("_n = 1").drop("_n")
    fresh = fresh.observe(wrote, F.count_if(F.col("_before").isNull()).alias("added"), F.count_if(F.col("_before").isNotNull()).alias("changed"))
    fresh = stored(fresh, "changed")
    counts = {**_metrics(seen, lambda: {"unchanged": told.where(same).count()}), **_metrics(wrote, lambda: {"added": 0, "changed": 0}), "removed": 0, "derived": 0}

    gone = fresh.select(id_col)
    places = [fresh.select(F.col(partition).alias("_p")), fresh.where("_before IS NOT NULL").select(F.col("_partition").alias("_p"))]
    if complete:
        missing = stored(before.join(arriving.select(id_col), id_col, "left_anti").select(id_col, partition), "missing")
        counts["removed"] = missing.count()
        gone = gone.unionByName(missing.select(id_col))
        places.append(missing.select(F.col(partition).alias("_p")))
    touched = [r[0] for r in collect_bounded(reduce(DataFrame.unionByName, places).distinct(), MAX_PARTITIONS)]
    if not touched:
        return counts

    new = fresh.select(*columns, "content_hash", F.lit(generation).alias("generation"))
    made = derive(new.select(*columns)).withColumn("generation", F.lit(generation))
    rows = Observation("derived")
    made = made.observe(rows, F.count(F.lit(1)).alias("derived"))
    made_before = read_if_present(spark, f"{path}/{derived}", made.schema) if generation > 1 else spark.createDataFrame([], made.schema)
    _replace(f"{path}/{derived}", made_before, gone, made, id_col, partition, touched, generation)
    counts |= _metrics(rows, lambda: {"derived": 0})
    _replace(f"{path}/{documents}", before, gone, new, id_col, partition, touched, generation)
    return counts
