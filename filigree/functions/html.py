"""Pages as Markdown, and Markdown in sections."""
from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.html_markdown import PAGE_BREAK, page_markdown
from filigree.functions.text import let


@F.pandas_udf(T.StringType())
def _markdown(pages: pd.Series) -> pd.Series:
    return pages.map(page_markdown)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else entities.unescape(t))


def unescape(text: Column) -> Column:
    """Decode character references of all HTML names and numbers once (`&amp;lt;` gives `&lt;`)."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)


def markdown(html: Column) -> Column:
    """A page as Markdown, see `page_markdown`; read in Arrow batches."""
    return _markdown(html)


def title(html: Column) -> Column:
    """Text of the first `<title>`, or null."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(unescape(raw), r"[ \t\r\n\f]+", " ")), F.lit(""))


HEADING = r"^(#{1,6}) +([^\n\f]*)"


BREAKS = r"(?md)(?=^#{1,6} )|(?=\f)"
SECTION_FIELDS = "struct<section_index:int,level:int,section:string,page:int,text:string,start:int>"


def sections(md: Column) -> Column:
    """Cut Markdown at headings and page breaks.

    Array of `(section_index, level, section, page, text, start)`. `section` is the
    heading in force, null (and its level 0) before the first; `page` counts page breaks and is null in a
    text without any. The texts joined again give the input.

    What a part inherits is carried from one part to the next in blocks of about the root
    of their number, as every appended list is copied.
    """
    none = F.array().cast(f"array<{SECTION_FIELDS}>")

    def step(state: Column, part: Column, paged: Column) -> Column:
        broke = F.startswith(part, F.lit(PAGE_BREAK))
        body = F.when(broke, F.substring(part, 2, 2147483647)).otherwise(part)
        headed = body.rlike(HEADING)
        level = F.when(headed, F.char_length(F.regexp_extract(body, HEADING, 1))).otherwise(state["level"])
        name = F.when(headed, F.trim(F.regexp_extract(body, HEADING, 2))).otherwise(state["section"])
        page = state["page"] + broke.cast("int")
        entry = F.struct(
            state["n"].alias("section_index"),
            level.alias("level"),
            name.alias("section"),
            F.when(paged, page).alias("page"),
            part.alias("text"),
            state["at"].alias("start"),
        )
        return F.struct(
            level.alias("level"),
            name.alias("section"),
            page.alias("page"),
            (state["at"] + F.char_length(part)).alias("at"),
            (state["n"] + 1).alias("n"),
            F.array_append(state["done"], entry).alias("done"),
        )

    def block_step(state: Column, block: Column, paged: Column) -> Column:
        fresh = F.struct(*[state[c].alias(c) for c in ("level", "section", "page", "at", "n")], none.alias("done"))
        return let(
            F.aggregate(block, fresh, lambda s, part: step(s, part, paged)),
            lambda s: F.struct(
                *[s[c].alias(c) for c in ("level", "section", "page", "at", "n")],
                F.array_append(state["done"], s["done"]).alias("done"),
            ),
        )

    def fold(parts: Column, paged: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(parts))).cast("int")
        firsts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), size)).otherwise(F.array().cast("array<int>"))
        start = F.struct(
            F.lit(0).alias("level"),
            F.lit(None).cast("string").alias("section"),
            F.lit(1).alias("page"),
            F.lit(0).alias("at"),
            F.lit(0).alias("n"),
            F.array().cast(f"array<array<{SECTION_FIELDS}>>").alias("done"),
        )
        return F.aggregate(
            firsts, start, lambda s, first: block_step(s, F.slice(parts, first, size), paged), lambda s: F.flatten(s["done"])
        )

    parts = F.filter(F.split(md, BREAKS), lambda p: p != "")
    paged = F.contains(md, F.lit(PAGE_BREAK))
    return F.coalesce(let(F.struct(parts.alias("parts"), paged.alias("paged")), lambda v: fold(v["parts"], v["paged"])), none)
