"""Splitting documents into overlapping passages, within each document row."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import let

CHUNK_TOKENS = 200
CHUNK_STRIDE = 150
# A word with the blanks after it: joined again, the pieces give back the text.
PIECE = r"(?:[^ \t\n\f\r]++[ \t\n\f\r]*+)"
MAX_UNIT = 200  # words matched by one repetition
LEADING_BLANKS = r"^[ \t\n\f\r]*"
TRAILING_BLANKS = r"[ \t\n\f\r]+$"


def passages(text: Column, size: int = CHUNK_TOKENS, stride: int = CHUNK_STRIDE) -> Column:
    """Array of `(text, token_count, start, end)`; character offsets, end exclusive.

    A window starts every `stride` words; the last one ends with the text. The text is
    cut once into units of words that divide both size and stride, and windows are put
    together from those, so cost grows with the words and not with their square.
    """
    common = math.gcd(size, stride)
    unit = max(d for d in range(1, min(common, MAX_UNIT) + 1) if common % d == 0)

    def words_in(piece: Column) -> Column:
        return F.size(F.regexp_extract_all(piece, F.lit(PIECE), 0))

    def units(blocks: Column, first: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(blocks, first + j))

    def cut(blocks: Column) -> Column:
        count = (F.size(blocks) - 1) * unit + words_in(F.element_at(blocks, -1))
        return let(count, lambda n: windows(blocks, n))

    def windows(blocks: Column, n: Column) -> Column:
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))
        lead = F.char_length(F.regexp_extract(text, LEADING_BLANKS, 0))
        starts = F.aggregate(
            F.sequence(F.lit(0), last),
            F.struct(lead.alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, i: F.struct(
                (
                    acc["at"] + F.char_length(F.array_join(units(blocks, i * (stride // unit), stride // unit), ""))
                ).alias("at"),
                F.array_append(acc["starts"], acc["at"]).alias("starts"),
            ),
            lambda acc: acc["starts"],
        )
        return F.transform(
            starts,
            lambda start, i: let(
                F.array_join(units(blocks, i * (stride // unit), size // unit), ""),
                lambda window: let(
                    F.regexp_replace(window, TRAILING_BLANKS, ""),
                    lambda passage: F.struct(
                        passage.alias("text"),
                        F.least(F.lit(size), n - i * stride).alias("token_count"),
                        start.alias("start"),
                        (start + F.char_length(passage)).alias("end"),
                    ),
                ),
            ),
        )

    nothing = F.array().cast("array<struct<text:string,token_count:int,start:int,end:int>>")
    blocks = F.regexp_extract_all(text, F.lit(PIECE + "{1,%d}" % unit), 0)
    return let(
        F.coalesce(blocks, F.array().cast("array<string>")),
        lambda b: F.when(F.size(b) > 0, cut(b)).otherwise(nothing),
    )


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.concat_ws("-", document_id.cast("string"), index.cast("string"))


def chunk_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
    keep: list[str] | None = None,
) -> DataFrame:
    """`(id, *keep, chunk_id, chunk_index, text, token_count, start, end)`, without a shuffle.

    Ids are derived from document and position, so chunking again gives the same ids.
    """
    kept = [id_col, *(keep or [])]
    cut = docs.select(*kept, F.posexplode(passages(F.col(text_col), size, stride)).alias("chunk_index", "_p"))
    return cut.select(
        *kept,
        chunk_id(F.col(id_col), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.col("_p.text").alias("text"),
        F.col("_p.token_count").alias("token_count"),
        F.col("_p.start").alias("start"),
        F.col("_p.end").alias("end"),
    )


def chunk_sections(
    sections: DataFrame,
    *,
    id_col: str = "document_id",
    size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Chunk documents held as `sections array<struct<section, page, text, start>>`.

    No passage crosses a section, so each names the one section (and page) it is from;
    indexes run through the document and offsets refer to its whole text.
    """
    kept = [id_col, *(keep or [])]
    chunks = F.flatten(
        F.transform(
            "sections",
            lambda s: F.transform(
                passages(s["text"], size, stride),
                lambda p: F.struct(
                    s["section"].alias("section"),
                    s["page"].alias("page"),
                    p["text"].alias("text"),
                    p["token_count"].alias("token_count"),
                    (s["start"] + p["start"]).alias("start"),
                    (s["start"] + p["end"]).alias("end"),
                ),
            ),
        )
    )
    cut = sections.select(*kept, F.posexplode(chunks).alias("chunk_index", "_p"))
    return cut.select(
        *kept,
        chunk_id(F.col(id_col), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        *[F.col(f"_p.{c}").alias(c) for c in ("section", "page", "text", "token_count", "start", "end")],
    )
