"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from fathom.sources.files import exists

METADATA = "chapter_title string, context_augmented boolean, split_from_long_paragraph boolean, boundary_truncated boolean, node_type string, start_line int, end_line int, parent string, is_orphan boolean, fallback_chunked boolean"
CHUNKS = f"chunk_id string, text string, source_file string, source string, series string, volume int, movie string, type string, topic string, chunk_mode string, chunk_size int, chunk_overlap int, metadata struct<{', '.join(x.replace(' ', ':', 1) for x in METADATA.split(', '))}>, paragraph_id string"
QUERIES = "query_id string, qid string, query string, query_type string, type string, difficulty string, domain string, book int, chapter string, expected_entity_or_paragraph string, gold_symbols array<string>, gold_sources array<string>, gold_paragraph_ids array<string>, gold_chunk_ids array<string>, notes string"


def text_files(spark: SparkSession, folder: str, extensions: Iterable[str] = (".txt", ".md"), recursive: bool = True, ordered: bool = True) -> DataFrame:
    """(path, source_file, text) of whole files by extension, whatever its case; in path order, which
    shuffles the texts, unless ``ordered`` is False. A folder that isn't there has none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, source_file string, text string")
    either = ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", f"{{{either}}}").load(folder)
    path = F.col("_metadata.file_path")
    found = files.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("source_file"), F.col("value").alias("text"))
    return found.orderBy("path") if ordered else found


def json_array(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    """Records of a file that is one JSON list (or one object), or of a folder of such files."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str = QUERIES) -> DataFrame:
    """One record a line; blank lines don't count, a malformed one fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", T._parse_datatype_string(schema) if isinstance(schema, str) else schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def json_lines_with_errors(spark: SparkSession, path: str, schema: str = QUERIES) -> DataFrame:
    """As ``json_lines``, but a malformed line is a row of nulls with ``_error`` (line number and text);
    a file that isn't there has none.

    Files are split like any other, however large. The number of a line in its file is its place in
    its split plus the lines of the file's splits before, by prefix sums over one row a split."""
    kind = T._parse_datatype_string(schema + ", _corrupt string")
    if not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema + ", _error string"))
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path, lineSep="\n").select("value", file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (before - F.col("first") + 1).alias("shift"))
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    numbered = parsed.join(F.broadcast(splits), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    error = F.when(F.col("r._corrupt").isNotNull(), F.format_string("line %d: %s", F.col("at") + F.col("shift"), F.left("value", F.lit(80))))
    return numbered.select("r.*", error.alias("_error")).drop("_corrupt")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def by_setting(spark: SparkSession, glob: str, schema: str, pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """Records of many JSON files with ``setting`` from the file name."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn("setting", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
