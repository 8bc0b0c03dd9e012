"""Metadata filters and the choice of a retrieval method."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def equals(wanted: Mapping[str, object], columns: list[str]) -> Column:
    """All keys equal; a key that rows lack counts as null there."""
    tests = [(F.col(k) if k in columns else F.lit(None)).eqNullSafe(F.lit(v)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matches(wanted: Mapping[str, object], columns: list[str]) -> Column:
    """As ``equals``, but a list stands for any of its values, null among them."""

    def one(key: str, value: object) -> Column:
        column = F.col(key) if key in columns else F.lit(None)
        if not isinstance(value, (list, tuple, set)):
            return column.eqNullSafe(F.lit(value))
        return reduce(lambda a, b: a | b, [column.eqNullSafe(F.lit(v)) for v in value], F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in wanted.items()], F.lit(True))


def parse_filter(text: str | None) -> dict | None:
    """A filter from JSON; text that isn't a JSON object warns and means no filter."""
    if not text:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        warnings.warn(f"not a JSON object, searching without a filter: {text!r}", stacklevel=2)
        return None
    return found


def as_documents(chunks: DataFrame) -> DataFrame:
    """Chunks with what a document always has: text, source file, volume and id, or their defaults."""
    has = set(chunks.columns)
    given = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    return chunks.select(
        F.coalesce(given("text", "string"), F.lit("")).alias("page_content"),
        F.coalesce(given("source_file", "string"), F.lit("Unknown")).alias("source"),
        F.coalesce(given("volume", "string"), F.lit("Unknown")).alias("volume"),
        F.coalesce(given("chunk_id", "string"), F.lit("-1")).alias("chunk_id"),
    )
