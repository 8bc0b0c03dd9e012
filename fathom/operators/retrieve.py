"""One interface over the retrieval methods: vector, text, hybrid."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathom.functions.text import content_id
from fathom.operators import bm25
from fathom.operators.embed import Embedder, TfIdf
from fathom.operators.filters import equals, matches
from fathom.operators.fusion import fuse_by_content, fuse_by_position, search_depth
from fathom.operators.knn import nearest

METHODS = ("vector", "bm25", "hybrid")


@dataclass
class VectorIndex:
    """Vectors (doc, embedding) and which embedder made them."""

    vectors: DataFrame
    embedder: str
    dim: int

    def check(self, embedder: Embedder) -> None:
        if (embedder.name, embedder.dim) != (self.embedder, self.dim):
            raise ValueError(f"the index is of {self.embedder} ({self.dim}), the query of {embedder.name} ({embedder.dim})")


def build_vector_index(chunks: DataFrame, embedder: Embedder, doc: str = "doc", text: str = "text") -> VectorIndex:
    return VectorIndex(embedder.embed(chunks.select(F.col(doc).alias("doc"), text), text, "embedding").select("doc", "embedding"), embedder.name, embedder.dim)


def save_vector_index(index: VectorIndex, embedder: TfIdf, folder: str) -> None:
    """Write vectors together with the state of the embedder that made them."""
    index.check(embedder)
    index.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    embedder.save(index.vectors.sparkSession, f"{folder}/embedder")


def open_vector_index(spark: SparkSession, folder: str) -> tuple[VectorIndex, TfIdf]:
    embedder = TfIdf.load(spark, f"{folder}/embedder")
    return VectorIndex(spark.read.parquet(f"{folder}/vectors"), embedder.name, embedder.dim), embedder


@dataclass
class Retriever:
    """Ranks the chunks (doc, text, any metadata) of a corpus for a table of queries (qid, query).

    The embedder is fitted on the chunks, and the text index built of them, when first needed; both
    are kept, so that further queries only search.
    """

    chunks: DataFrame
    embedder: Embedder | None = None
    index: VectorIndex | None = None
    text_index: bm25.SparseIndex | None = field(default=None, repr=False)

    def _vector(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        if self.embedder is None:
            self.embedder = TfIdf.fit(self.chunks)
        if self.index is None:
            self.index = build_vector_index(self.chunks, self.embedder)
        index = self.index
        index.check(self.embedder)
        vectors = index.vectors.join(chunks.select("doc"), "doc", "left_semi")
        asked = self.embedder.embed(queries, "query", "query_vec")
        return nearest(vectors, asked, k, vec="doc", embedding="embedding").select("qid", F.col("vec").alias("doc"), "rank")

    def retrieve(self, queries: DataFrame, k: int = 3, wanted: Mapping[str, object] | None = None, method: str = "hybrid") -> DataFrame:
        """(qid, doc, rank): arms go to ``search_depth``, are fused by position, then filtered: what
        passes the filter but lies deeper is not found. Unknown methods mean hybrid."""
        depth = search_depth(k)
        passing = self.chunks.where(equals(wanted, self.chunks.columns)).select("doc") if wanted else None

        def cut(arm: DataFrame) -> DataFrame:
            arm = arm if passing is None else arm.join(passing, "doc", "left_semi")
            again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
            return arm.select("qid", "doc", again.alias("rank")).where(F.col("rank") <= k)

        if method == "vector":
            return cut(self._vector(self.chunks, queries, depth))
        if self.text_index is None:
            self.text_index = bm25.build_index(self.chunks, "doc")
        text = bm25.top(self.text_index, queries, depth)
        if method == "bm25":
            return cut(text)
        return fuse_by_position(self._vector(self.chunks, queries, depth), text, depth, k, passing).select("qid", "doc", "rank")

    def retrieve_distinct(self, queries: DataFrame, k: int = 5, wanted: Mapping[str, object] | None = None) -> DataFrame:
        """(qid, content, doc, score, rank): filters come first, so the text index is that of what
        passes; arms give ``k`` each and fuse by content."""
        chunks = self.chunks.where(matches(wanted, self.chunks.columns)) if wanted else self.chunks
        text = bm25.top(bm25.build_index(chunks, "doc", lower=True), queries, k)
        return fuse_by_content(self._vector(chunks, queries, k), text, chunks.select("doc", content_id(F.col("text")).alias("content")), k)


def distinct_sources(ranked: DataFrame) -> DataFrame:
    """(qid, source, first_rank) in the order in which sources first appear."""
    return ranked.groupBy("qid", "source").agg(F.min("rank").alias("first_rank"))


def suggest_gold(paragraphs: DataFrame, queries: DataFrame, n: int = 3, doc: str = "paragraph_id", text: str = "text") -> DataFrame:
    """``queries`` (qid, query, expected, gold_paragraph_ids) with the ``n`` best paragraphs for what is
    asked and expected, in lower case, as an array of (rank, id, source_file, score, preview). Gold
    that is there stays; null becomes an empty list."""
    asked = queries.select("qid", F.lower(F.trim(F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("expected", F.lit(""))))).alias("query"))
    best = bm25.top(bm25.build_index(paragraphs, doc, text, lower=True), asked, n).withColumnRenamed("doc", doc)
    files = F.col("source_file") if "source_file" in paragraphs.columns else F.lit(None).cast("string")
    known = best.join(paragraphs.select(doc, files.alias("source_file"), F.left(F.col(text), F.lit(160)).alias("preview")), doc)
    found = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(doc).alias("id"), "source_file", "score", "preview"))).alias("suggested_gold_paragraphs"))
    kept = queries.withColumn("gold_paragraph_ids", F.coalesce("gold_paragraph_ids", F.array().cast("array<string>")))
    return kept.join(found, "qid", "left")


def ask(chunks: DataFrame, queries: DataFrame, k: int = 3, wanted: Mapping[str, object] | None = None, method: str = "hybrid", mode: str = "extractive", make=None, embedder: Embedder | None = None) -> DataFrame:
    """(qid, query, answer, sources, error): from questions (qid, query) over chunks (doc, text, any
    metadata) to answers, by one retrieval of ``k`` chunks each and one answer mode. ``sources`` are
    the chunks' ids by rank."""
    ranked = Retriever(chunks, embedder).retrieve(queries, k, wanted, method)
    held = ranked.join(chunks.select("doc", "text"), "doc").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "text"))).alias("x"))
    return answered(queries.select("qid", "query").join(held, "qid", "left"), mode, make)


def answered(rows: DataFrame, mode: str = "extractive", make=None) -> DataFrame:
    """(qid, query, answer, sources, error) for rows (qid, query, x), x being what was found: an array
    of (rank, doc, text), null for nothing."""
    from fathom.operators.answers import FirstSentences, answer_rows

    none = F.array().cast("array<string>")
    rows = rows.select("qid", "query", F.coalesce(F.transform("x", lambda x: x["text"]), none).alias("contexts"), F.coalesce(F.transform("x", lambda x: x["doc"].cast("string")), none).alias("sources"))
    said = answer_rows(rows, mode, make or FirstSentences)
    return rows.join(said, "qid").select("qid", "query", "answer", "sources", "error")
