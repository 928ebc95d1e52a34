"""Message parts of streamed answers, and the messages they make up."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT, SOURCE, ERROR, FINISH = "text-delta", "source", "error", "finish"
# Error codes of a failed run.
ERROR_CODES = ("unauthorized", "thread_not_found", "retrieval_failed", "grounding_failed")
BLOCK = 1000
DELTA = r"[^ \t\n\f\r]*[ \t\n\f\r]*"


def to_parts(messages: DataFrame) -> DataFrame:
    """Split `(message_id, text, sources, error)` into ordered parts.

    Text deltas come word by word, then the sources, then `finish`; a message with an
    error code ends in `error` instead.
    """
    part = "struct<part_type:string,payload:string>"
    words = F.filter(F.regexp_extract_all("text", F.lit(DELTA), 0), lambda w: w != "")
    deltas = F.transform(words, lambda w: F.struct(F.lit(TEXT).alias("part_type"), w.alias("payload")))
    refs = F.transform("sources", lambda s: F.struct(F.lit(SOURCE).alias("part_type"), s.alias("payload")))
    end = F.struct(
        F.when(F.col("error").isNull(), FINISH).otherwise(ERROR).alias("part_type"),
        F.col("error").alias("payload"),
    )
    nothing = F.array().cast(f"array<{part}>")
    parts = F.concat(F.coalesce(deltas, nothing), F.coalesce(refs, nothing), F.array(end))
    return messages.select("message_id", F.posexplode(parts).alias("seq", "part")).select(
        "message_id", "seq", "part.part_type", "part.payload"
    )


def assemble_messages(parts: DataFrame) -> DataFrame:
    """`(message_id, text, n_deltas, n_sources, status, error)` from parts in any order.

    `status` is `complete` after `finish`, `error` after an error, else `partial`. Text
    is joined in blocks of consecutive parts first and the blocks after that, so even
    one message with most of the parts is put together by many tasks.
    """
    is_text = F.col("part_type") == TEXT
    blocks = parts.groupBy("message_id", (F.col("seq") / BLOCK).cast("int").alias("_block")).agg(
        F.array_sort(F.collect_list(F.when(is_text, F.struct("seq", "payload")))).alias("_deltas"),
        F.count_if(is_text).alias("_n"),
        F.count_if(F.col("part_type") == SOURCE).alias("_sources"),
        F.max(F.col("part_type") == FINISH).alias("_finished"),
        F.max(F.when(F.col("part_type") == ERROR, F.coalesce("payload", F.lit("")))).alias("_error"),
    )
    joined = blocks.select(
        "message_id",
        F.struct("_block", F.array_join(F.transform("_deltas", lambda d: d["payload"]), "").alias("text")).alias("_b"),
        "_n",
        "_sources",
        "_finished",
        "_error",
    )
    status = F.when(F.max("_error").isNotNull(), "error").when(F.max("_finished"), "complete").otherwise("partial")
    return joined.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["text"]), "").alias("text"),
        F.sum("_n").alias("n_deltas"),
        F.sum("_sources").alias("n_sources"),
        status.alias("status"),
        F.max("_error").alias("error"),
    )
