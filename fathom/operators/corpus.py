"""Chunks of a whole corpus, prose and code, with what is known of each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fathom.operators.chunkers import chunk_texts
from fathom.operators.classify import Rule, classify
from fathom.operators.code import chunk_code

PROSE_MODES, CODE_MODES = ("fixed", "line", "token", "structure_text"), ("fixed", "line", "token", "structure_code")
LABELS = ("source", "series", "volume", "movie", "type", "topic")
METADATA = {"chapter_title": "string", "context_augmented": "boolean", "split_from_long_paragraph": "boolean", "boundary_truncated": "boolean", "node_type": "string", "start_line": "int", "end_line": "int", "parent": "string", "is_orphan": "boolean", "fallback_chunked": "boolean"}


def _finish(pieces: DataFrame, mode: str, size: int, overlap: int) -> DataFrame:
    has = set(pieces.columns)
    given = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    known = F.struct(*[given(c, kind) for c, kind in METADATA.items()]).alias("metadata")
    labels = [given(c, "int" if c == "volume" else "string") for c in LABELS]
    return pieces.select(given("chunk_id", "string"), "text", "source_file", *labels, F.lit(mode).alias("chunk_mode"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), known)


def chunk_prose(files: DataFrame, mode: str, size: int, overlap: int, rules: Sequence[Rule] = ()) -> DataFrame:
    """Chunks of text files (source_file, text) with the labels that ``rules`` give their file.
    Ids count before blank pieces go, so they keep gaps. A mode that isn't one of prose has none."""
    if mode not in PROSE_MODES:
        return _finish(files.where("false").withColumn("chunk_id", F.lit("")), mode, size, overlap)
    pieces = chunk_texts(files, mode, size, overlap, "source_file").withColumnRenamed("pos", "chunk_id")
    labels = classify(files, rules).drop("text") if rules else files.select("source_file")
    return _finish(pieces.join(labels.dropDuplicates(["source_file"]), "source_file"), mode, size, overlap)


def chunk_sources(files: DataFrame, mode: str, size: int, overlap: int) -> DataFrame:
    """Chunks of code files (source_file, text); their source is "code". A mode that isn't one of code has none."""
    if mode not in CODE_MODES:
        return _finish(files.where("false").withColumn("chunk_id", F.lit("")), mode, size, overlap)
    return _finish(chunk_code(files, mode, size, overlap).withColumn("source", F.lit("code")), mode, size, overlap)


def chunk_corpus(texts: DataFrame, code: DataFrame, mode: str, size: int, overlap: int, rules: Sequence[Rule] = ()) -> DataFrame:
    """Chunks of both kinds of files in one table; a mode of one kind leaves the other out."""
    return chunk_prose(texts, mode, size, overlap, rules).unionByName(chunk_sources(code, mode, size, overlap))
