"""Exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Bytes of query vectors that go to every task at once; more are searched in blocks.
BLOCK_BYTES = 64 << 20
#: Differences of queries and vectors that a worker holds at once.
CUBE = 1 << 20


def query_blocks(queries: DataFrame, qid: str, query: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a stated query set, in blocks of a bounded size."""
    block, size = [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block], dtype=np.float64)

    for r in queries.select(F.col(qid).cast("long"), F.col(query).cast("array<double>")).toLocalIterator():
        block.append(r)
        size += 8 * len(r[1])
        if size >= BLOCK_BYTES:
            yield made()
            block, size = [], 0
    if block:
        yield made()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec_id", embedding: str = "embedding", qid: str = "qid", query: str = "query_vec", dim: int | None = None) -> DataFrame:
    """(qid, vec, distance, rank from 1): the ``k`` nearest vectors by squared L2, ties by vector id.

    Queries are a stated set and go to the tasks in blocks of a bounded size; each task keeps its own
    best ``k`` a query as it streams over its vectors, so what is shuffled is tasks x queries x k
    rows. Distances are sums of squared differences in double, rounded before they rank. Vectors that
    are null or of another dimension are an error.
    """
    spark = vectors.sparkSession

    def search(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best_d, best_v = np.empty((len(names), 0)), np.empty((len(names), 0), dtype=np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                step = min(4096, max(64, CUBE // max(1, q.size)))
                for i in range(0, len(ids), step):
                    near = x[i : i + step]
                    if q.size * step <= CUBE:
                        cube = q[:, None, :] - near[None, :, :]
                        d = np.square(cube, out=cube).sum(axis=2)
                    else:
                        d = np.stack([((near - one) ** 2).sum(axis=1) for one in q])
                    best_d = np.concatenate((best_d, np.round(d, 6)), axis=1)
                    best_v = np.concatenate((best_v, np.broadcast_to(ids[i : i + step], d.shape)), axis=1)
                    order = np.lexsort((best_v, best_d), axis=1)[:, :k]
                    best_d, best_v = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_v, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_d.shape[1])), pa.array(best_v.ravel()), pa.array(best_d.ravel())], names=["qid", "vec", "distance"])

        return vectors.select(F.col(vec).cast("long").alias("vec"), F.col(embedding).cast("array<float>").alias("e")).mapInArrow(run, "qid long, vec long, distance double")

    found = spark.createDataFrame([], "qid long, vec long, distance double")
    for n, block in enumerate(query_blocks(queries, qid, query)):
        found = search(block) if n == 0 else found.unionByName(search(block))
    order = Window.partitionBy("qid").orderBy("distance", "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
