"""Approximate nearest neighbours: inverted lists by centroid, a folder of files for each list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathom.operators.knn import nearest, query_blocks
from fathom.runtime import new_path

#: Rows that centroids are fitted on at most; every row of the table is then in a list.
SAMPLE = 50_000


@dataclass
class ListIndex:
    """Vectors (vec, embedding) in Parquet files, partitioned by ``list``: the centroid they are nearest to."""

    folder: str
    centroids: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("vec long, embedding array<float>, list int").parquet(f"{self.folder}/lists")


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid nearest to each row, the first of equal ones."""
    return (np.square(centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def fit_centroids(vectors: DataFrame, lists: int, rounds: int = 10, sample: int = SAMPLE, vec: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Centroids by ``rounds`` of k-means on the ``sample`` rows of the smallest hashes of their id: a
    bounded sample that doesn't depend on the order of the table. No more lists than rows."""
    rows = vectors.select(F.xxhash64(F.col(vec)).alias("h"), F.col(embedding).cast("array<double>").alias("e")).orderBy("h").limit(sample).select("e").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = np.stack(rows.column(0).to_pylist()).astype(np.float64)
    centroids = np.unique(x, axis=0)[np.random.default_rng(7).permutation(len(np.unique(x, axis=0)))[:lists]]
    for _ in range(rounds):
        at = np.concatenate([_near(x[i : i + 4096], centroids) for i in range(0, len(x), 4096)])
        count = np.bincount(at, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, at, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _write(vectors: DataFrame, centroids: np.ndarray, folder: str, mode: str, vec: str, embedding: str) -> None:
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_near(x, held.value), pa.int32())], names=["vec", "embedding", "list"])

    rows = vectors.select(F.col(vec).cast("long").alias("vec"), F.col(embedding).cast("array<float>").alias("embedding"))
    made = rows.mapInArrow(assign, "vec long, embedding array<float>, list int")
    # ranges of list and id are even, so a list with a third of all rows is several files of several tasks
    made.repartitionByRange("list", "vec").write.partitionBy("list").mode(mode).parquet(f"{folder}/lists")


def build_lists(vectors: DataFrame, lists: int = 256, folder: str | None = None, rounds: int = 10, sample: int = SAMPLE, vec: str = "vec_id", embedding: str = "embedding") -> ListIndex:
    """Fit centroids on a bounded sample and put every vector in the list of its nearest centroid.

    Vectors must not be null and all of one dimension. An empty table gives an index without lists.
    """
    spark = vectors.sparkSession
    folder = (folder or new_path(spark, "lists")).rstrip("/")
    centroids = fit_centroids(vectors, lists, rounds, sample, vec, embedding)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    _write(vectors, centroids, folder, "overwrite", vec, embedding)
    return ListIndex(folder, centroids)


def open_lists(spark: SparkSession, folder: str) -> ListIndex:
    rows = sorted(spark.read.parquet(f"{folder}/centroids").collect())
    return ListIndex(folder, np.array([r["centroid"] for r in rows]))


def add_vectors(index: ListIndex, vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding") -> None:
    """Put more vectors in the lists; centroids stay as they are."""
    _write(vectors, index.centroids, index.folder, "append", vec, embedding)


def search_lists(index: ListIndex, queries: DataFrame, k: int, probes: int = 8, qid: str = "qid", query: str = "query_vec", dim: int | None = None) -> DataFrame:
    """(qid, vec, distance, rank): the ``k`` nearest vectors of each query among those in the ``probes``
    lists whose centroids are nearest to it, by squared L2, ties by id.

    With as many probes as lists the answer is exact. Queries, a stated set, go to the tasks in blocks
    of a bounded size; of the files only those in a folder that some query of the block probes are
    read, and a vector is held against the queries that probe its list.
    """
    spark, found = queries.sparkSession, None
    for names, q in query_blocks(queries, qid, query):
        far = np.square(index.centroids).sum(axis=1) - 2 * q @ index.centroids.T
        probed = np.argsort(far, axis=1, kind="stable")[:, :probes]
        by_list: dict[int, np.ndarray] = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        held = spark.sparkContext.broadcast((names, q, by_list))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q, by_list = held.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                ids, lists = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                for c in np.unique(lists).tolist():
                    rows = np.flatnonzero(lists == c)
                    for n in by_list[c].tolist():
                        d = np.round(np.square(x[rows] - q[n]).sum(axis=1), 6)
                        d0, v0 = best.get(n, (np.empty(0), np.empty(0, dtype=np.int64)))
                        d, v = np.concatenate((d0, d)), np.concatenate((v0, ids[rows]))
                        order = np.lexsort((v, d))[:k]
                        best[n] = (d[order], v[order])
            for n, (d, v) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), names[n])), pa.array(v), pa.array(d)], names=["qid", "vec", "distance"])

        near = index.vectors(spark).where(F.col("list").isin(*by_list)).mapInArrow(run, "qid long, vec long, distance double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], "qid long, vec long, distance double")
    order = Window.partitionBy("qid").orderBy("distance", "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(index: ListIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8, vec: str = "vec_id") -> DataFrame:
    """One row (k, queries, recall): the share of the exact ``k`` nearest vectors that ``search_lists`` finds."""
    exact = nearest(vectors, queries, k, vec=vec).select("qid", "vec")
    found = search_lists(index, queries, k, probes).select(F.col("qid").alias("q"), F.col("vec").alias("v"))
    both = exact.join(found, (F.col("qid") == F.col("q")) & (F.col("vec") == F.col("v")), "left")
    return both.agg(F.lit(k).alias("k"), F.count_distinct("qid").alias("queries"), F.round(F.avg(F.col("v").isNotNull().cast("int")), 6).alias("recall"))
