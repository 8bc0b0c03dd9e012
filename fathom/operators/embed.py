"""Embedders that need no model file: hashed terms, plain or weighed by what a corpus has shown."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from fathom.functions.text import tokens


class Embedder(Protocol):
    """Adds a vector column to rows with text. ``name`` and ``dim`` go along with an index."""

    name: str
    dim: int

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


def _words(text: Column) -> Column:
    return tokens(F.coalesce(text, F.lit("")), lower=True)


def _buckets(words: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each token in lists: the first 32 bits of its MD5, modulo ``dim``; a token that comes
    often is hashed once."""
    flat = words.flatten().dictionary_encode()
    held = np.array([int.from_bytes(hashlib.md5(t).digest()[:4]) % dim for t in flat.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), sizes), held[flat.indices.to_numpy(zero_copy_only=False)]


def _unit_vectors(dim: int, weights: np.ndarray | None):
    @F.arrow_udf(ArrayType(FloatType()))
    def vectors(words: pa.Array) -> pa.Array:
        rows, b = _buckets(words, dim)
        held = np.bincount(rows * dim + b, minlength=len(words) * dim).reshape(-1, dim).astype(np.float64)
        if weights is not None:
            held *= weights
        size = np.sqrt(np.square(held).sum(axis=1, keepdims=True))
        held /= np.where(size > 0, size, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(held.astype(np.float32).ravel()))

    return vectors


@dataclass
class HashedTf:
    """Counts of hashed tokens, scaled to length 1; the same for every corpus. Without tokens all 0."""

    dim: int = 256

    @property
    def name(self) -> str:
        return "hashed-tf"

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        return rows.withColumn(out, _unit_vectors(self.dim, None)(_words(F.col(text))))


@dataclass
class TfIdf:
    """Counts of hashed tokens, each weighed by how rare its bucket was in the corpus of ``fit``.

    The weights are the state: ``dim`` numbers, ln((N + 1) / (df + 1)), whatever the corpus. Their
    digest is part of the name, so an index made with one fit refuses queries of another.
    """

    idf: np.ndarray = field(repr=False)
    documents: int

    @property
    def dim(self) -> int:
        return len(self.idf)

    @property
    def name(self) -> str:
        return f"tf-idf-{hashlib.sha256(np.ascontiguousarray(self.idf, dtype='<f8').tobytes()).hexdigest()[:16]}"

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text", dim: int = 256) -> TfIdf:
        """One pass over the corpus; documents of each bucket are partial sums, ``dim`` rows in the end."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, b = _buckets(batch.column(0), dim)
                held = np.zeros((batch.num_rows, dim), dtype=bool)
                held[rows, b] = True
                n = np.append(held.sum(axis=0), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([*range(dim), -1], pa.int32())], names=["n", "b"])

        found = corpus.select(_words(F.col(text)).alias("words")).mapInArrow(count, "n long, b int").groupBy("b").agg(F.sum("n").alias("n"))
        seen = np.zeros(dim, dtype=np.int64)
        documents = 0
        for r in found.collect():
            if r["b"] < 0:
                documents = r["n"]
            else:
                seen[r["b"]] = r["n"]
        return cls(np.log((documents + 1) / (seen + 1)), documents)

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        return rows.withColumn(out, _unit_vectors(self.dim, self.idf)(_words(F.col(text))))

    def save(self, spark: SparkSession, folder: str) -> None:
        row = [(self.name, self.documents, self.idf.tolist())]
        spark.createDataFrame(row, "name string, documents long, idf array<double>").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TfIdf:
        row = spark.read.parquet(folder).first()
        made = cls(np.array(row["idf"]), row["documents"])
        if made.name != row["name"]:
            raise ValueError(f"weights in {folder} are not those of {row['name']}")
        return made
