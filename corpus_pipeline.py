"""From raw documents to token files: five operators, each working on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Between stages the documents are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm.decontaminate import remove_contamination
from fathom.llm.jaccard import keep_one_of_each
from fathom.llm.mixing import draw_mix
from fathom.llm.quality import keep_good
from fathom.llm.queries import vocabulary
from fathom.llm.token_files import token_digests, write_token_files
from fathom.runtime import discard, materialize, work_scope


#: What a tokenizing worker holds: less than by itself, since executors keep memory of the stages before.
REMEMBERED, BLOCK_CHARS = 20_000_000, 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Repeated rows are
    judged each."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id. Texts without
    words are near to nothing and stay; rows that repeat id and text stay once."""
    return keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go. Null texts stay null, repeated
    rows are cut each, and an empty benchmark cuts nothing."""
    clean = remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is one, the last; null texts
    weigh nothing."""
    return draw_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; what they hold of each document comes back. A null text is the end id
    alone, copies of a document follow each other, and no document makes no file."""
    folder, _ = write_token_files(docs, vocabulary(), remembered=REMEMBERED, block_chars=BLOCK_CHARS)
    return token_digests(spark, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("tokens", tokens)]

#: Estimation, hashing and a tokenizer have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage has used goes once its result is written, and so does
    the result before. Nulls, repeats and empty tables are as the stages' operators say; an empty
    table goes through all of them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with work_scope() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
