"""Filters on open metadata: a small predicate tree over typed columns and a Variant column."""
from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The comparisons of a leaf.
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "exists")
TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def compiled(predicate: dict[str, Any], typed: list[str], extra: str = "extra") -> Column:
    """The condition of a predicate tree.

    A node is `{"and": [...]}`, `{"or": [...]}`, `{"not": node}` or a leaf such as
    `{"field": "lang", "in": ["en", "de"]}` or `{"field": "deal.size", "ge": 5}`. A field in
    `typed` is that column, and its part of an `and` can be pushed to the scan; any other is
    a path in the Variant column `extra`, read as the type of the value it is compared with.
    An absent or differently typed key meets no comparison (`ne` and `not` included), only
    `exists` tells. Values are literals, never SQL text.
    """
    if "and" in predicate or "or" in predicate:
        name = "and" if "and" in predicate else "or"
        parts = [compiled(p, typed, extra) for p in predicate[name]]
        if not parts:
            return F.lit(name == "and")
        return reduce(Column.__and__ if name == "and" else Column.__or__, parts)
    if "not" in predicate:
        return ~compiled(predicate["not"], typed, extra)
    [comparison] = [c for c in predicate if c != "field"]
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison: {comparison}")
    value = predicate[comparison]
    if comparison == "exists":
        there = _field(predicate["field"], typed, extra, "variant").isNotNull()
        return there if value else ~there
    sample = value[0] if comparison == "in" and value else value
    if comparison == "in" and not value:
        return F.lit(False)
    if type(sample) not in TYPES:
        raise ValueError(f"no comparison with {type(sample).__name__}")
    field = _field(predicate["field"], typed, extra, TYPES[type(sample)])
    if comparison == "in":
        return field.isin(list(value))
    compare = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}[comparison]
    return getattr(field, compare)(F.lit(value))


def _field(name: str, typed: list[str], extra: str, kind: str) -> Column:
    if name in typed:
        return F.col(name)
    if not name or any(not part.replace("_", "").isalnum() for part in name.split(".")):
        raise ValueError(f"not a path: {name!r}")
    return F.try_variant_get(F.col(extra), f"$.{name}", kind)
