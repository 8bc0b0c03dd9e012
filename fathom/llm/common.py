"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, NullType

from fathom.functions.text import let as let

#: The white space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Return freed memory to the system: workers stay, and later stages want it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have this
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def long_id(df: DataFrame, name: str) -> Column:
    """An integer id as long; ids of other types are refused before anything runs."""
    kind = df.select(F.col(f"`{name}`")).schema[0].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{name} must be an integer, not {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the byte-wise fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words of a text that isn't null, in order."""
    parts = F.split(text, SPACE_RUN, -1)
    return F.filter(parts, lambda w: w != "")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the columns ``new``; input columns of those names give way to them."""
    taken = {name.lower() for name in new}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def prefix_sums(df: DataFrame, part: str, order: list[str], summed: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each expression over all rows up to and with a row, in the order of
    ``part`` and then ``order``. Sums run within the parts, each in one task, and are based on the
    totals of the parts before, a row each: parts should be many, even and follow the order."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(part).agg(*[F.sum(c).alias(name) for name, c in summed.items()])
    bases = totals.select(part, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__base_{name}") for name in summed])
    run = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.join(F.broadcast(bases), part)
    return placed.select(*[placed[c] for c in df.columns], *[(F.col(f"__base_{name}") + F.sum(c).over(run)).alias(name) for name, c in summed.items()])
