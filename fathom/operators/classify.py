"""Rule-based labels of files, and headers that put metadata into the text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Rule:
    """A file whose name matches ``name`` and whose text, in lower case, holds one of ``terms`` (if
    any are given) gets ``labels``."""

    labels: dict[str, str]
    name: str = ""
    terms: Sequence[str] = ()

    def test(self, name: Column, text: Column) -> Column:
        found = name.rlike(self.name) if self.name else F.lit(True)
        if not self.terms:
            return found
        low, any_ = F.lower(text), F.lit(False)
        for t in self.terms:
            any_ = any_ | F.contains(low, F.lit(t))
        return found & any_


def classify(files: DataFrame, rules: Sequence[Rule], name: str = "source_file", text: str = "text") -> DataFrame:
    """``files`` with the labels of the first rule that matches; null where none gives one."""
    keys = list(dict.fromkeys(k for r in rules for k in r.labels))
    out = files
    for key in keys:
        value = None
        for r in rules:
            test, label = r.test(F.col(name), F.coalesce(F.col(text), F.lit(""))), F.lit(r.labels.get(key))
            value = F.when(test, label) if value is None else value.when(test, label)
        out = out.withColumn(key, value)
    return out


#: Fields of a header, in order; a volume counts even if it is 0.
HEADER = (("File", "source_file"), ("parent", "parent"), ("node_type", "node_type"), ("source", "source"), ("volume", "volume"), ("topic", "topic"), ("series", "series"))


def inject_header(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with a line of what is known of them in front of the text."""
    has = set(chunks.columns)
    fields = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in HEADER if c in has]
    head = F.concat_ws(" | ", *fields) if fields else F.lit("")
    return chunks.withColumn(text, F.when(head == "", F.col(text)).otherwise(F.concat(F.lit("["), head, F.lit("]\n"), F.col(text))))
