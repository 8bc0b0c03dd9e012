"""Where inputs lie: the first path that exists, settings with all their files."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def first_existing(spark: SparkSession, candidates: Iterable[str], default_first: bool = True) -> str | None:
    """The first candidate that exists; without one the first of all, or None."""
    every = list(candidates)
    return next((p for p in every if exists(spark, p)), every[0] if default_first and every else None)


def chunk_and_index_paths(spark: SparkSession, pairs: Iterable[tuple[str, str]], environ: Mapping[str, str] = os.environ) -> tuple[str | None, str | None]:
    """Paths of chunks and index: CHUNKS_PATH with INDEX_PATH if set, else the first pair that exists."""
    if path := environ.get("CHUNKS_PATH"):
        pairs = [(path, environ.get("INDEX_PATH", path)), *pairs]
    return next(((c, i) for c, i in pairs if exists(spark, c) and exists(spark, i)), (None, None))


def discover_settings(chunk_files: DataFrame, index_files: DataFrame, path: str = "path") -> DataFrame:
    """(setting) of files named <anything>_<mode>_<size>.<ext> that both listings have, in order."""

    def named(files: DataFrame) -> DataFrame:
        return files.select(F.regexp_extract(path, r"([a-z]+(?:_[a-z]+)*?_\d+)\.[a-z]+$", 1).alias("setting")).where("setting <> ''").select(F.regexp_replace("setting", "^(chunks|index)_", "").alias("setting"))

    return named(chunk_files).join(named(index_files), "setting", "left_semi").distinct().orderBy("setting")
