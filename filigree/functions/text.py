"""Tokens and term counts as native column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_BREAK = r"[^a-z0-9]+"
UNICODE_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column, unicode: bool = False) -> Column:
    """Lower-cased terms in text order; an absent text has none."""
    parts = F.split(F.lower(text), UNICODE_BREAK if unicode else ASCII_BREAK)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a bound variable."""
    return F.transform(F.array(value), body)[0]
