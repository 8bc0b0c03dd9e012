"""Sinks: JSON, CSV and Parquet tables, split and grouped text files, small formatted reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters from which on a list is a file of its own.
LIST_CHARS = 1 << 23


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record a line, in files that a cluster writes side by side."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON list in one file, for a result whose size a report bounds."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    whole = rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    whole.coalesce(1).write.mode(mode).text(path)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to lists of a bounded size."""
    held, chars = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["[\n" + ",\n".join(held) + "\n]"], pa.string())], names=["value"])

    for batch in batches:
        for j in batch.column(0):
            held.append(j.as_py())
            chars += len(held[-1])
            if chars >= LIST_CHARS:
                yield made()
                held, chars = [], 0
    if held:
        yield made()


def write_json_lists(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of any size as JSON lists of a bounded one, each a file, that a cluster writes side by side;
    ``readers.json_array`` reads the folder."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    rows.mapInArrow(_lists, "value string").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_metrics(metrics: DataFrame, details: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Two tables: <path>/metrics and <path>/details."""
    metrics.write.mode(mode).json(f"{path}/metrics")
    details.write.mode(mode).json(f"{path}/details")


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Columns in a fixed order, with a header, in one file."""
    df.select(*columns).coalesce(1).write.mode(mode).csv(path, header=True)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def equal_slices(texts: DataFrame, n: int = 7, text: str = "text") -> DataFrame:
    """Each text in ``n`` slices of len // n characters, the last with the rest, stripped."""
    size = F.floor(F.length(text) / n)
    rest = [c for c in texts.columns if c != text]
    each = texts.select(*rest, text, size.alias("__size"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    piece = F.when(F.col("slice") == n - 1, F.substring(F.col(text), (F.col("slice") * F.col("__size") + 1).cast("int"), F.length(text))).otherwise(F.substring(F.col(text), (F.col("slice") * F.col("__size") + 1).cast("int"), F.col("__size").cast("int")))
    return each.select(*rest, "slice", F.regexp_replace(piece, r"^\s+|\s+$", "").alias(text))


SEPARATOR = "\n\n" + "=" * 40 + "\n\n"


def grouped_files(records: DataFrame, order: str, text: str, size: int = 10, files: int = 3) -> DataFrame:
    """(file, text): the first ``size`` x ``files`` records in order, ``size`` to a file."""
    from pyspark.sql import Window

    first = records.orderBy(order).limit(size * files).withColumn("n", F.row_number().over(Window.orderBy(order)))
    first = first.withColumn("file", F.floor((F.col("n") - 1) / size))
    return first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text))), lambda x: x[text]), SEPARATOR).alias("text"))


def boxed(text: str, most: int = 80) -> str:
    """A box as wide as the longest line, ``most`` at most; longer lines stick out."""
    lines = text.splitlines() or [""]
    width = min(max(map(len, lines)), most)
    return "\n".join(["+" + "-" * (width + 2) + "+", *[f"| {x.ljust(width)} |" for x in lines], "+" + "-" * (width + 2) + "+"])
