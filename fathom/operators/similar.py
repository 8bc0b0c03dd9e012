"""The most similar context of each sentence, question by question, without a join of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of sentence vectors that go to every task at once; more are held against the contexts in blocks.
BLOCK_BYTES = 64 << 20
#: Components that are multiplied first; the lengths of what is left bound the rest.
FIRST = 16


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


class _Question:
    """Sentences of one question and the best similarity of each so far."""

    def __init__(self, at: list[int], sids: list[object], vectors: list[list[float]]):
        self.at, self.sids = np.array(at), np.array(sids, dtype=object)
        self.units = _units(np.array(vectors, dtype=np.float64))
        self.rest = np.sqrt(np.square(self.units[:, FIRST:]).sum(axis=1))

    def hold(self, best: np.ndarray, contexts: np.ndarray, sids: np.ndarray | None) -> None:
        """Raise ``best`` by ``contexts`` (a row each); only those are multiplied in full that may do so."""
        x = _units(contexts)
        bound = self.units[:, :FIRST] @ x[:, :FIRST].T + np.outer(self.rest, np.sqrt(np.square(x[:, FIRST:]).sum(axis=1)))
        near = np.flatnonzero((bound + 1e-9 > best[self.at][:, None]).any(axis=0))
        if not len(near):
            return
        likeness = self.units @ x[near].T
        if sids is not None:
            likeness[self.sids[:, None] == sids[near][None, :]] = -np.inf
        best[self.at] = np.maximum(best[self.at], likeness.max(axis=1))


def most_similar(sentences: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, sid, best): the cosine of each sentence (qid, sid, v) with the context (qid, v) of its question
    that is most like it; null without one. Contexts with a ``sid`` are none of the sentence of that sid.

    Sentences go to the tasks in blocks of a bounded size. A task streams over its contexts, multiplies
    the first components, bounds the rest by the lengths, and keeps the best of each sentence, so what is
    shuffled is tasks x sentences rows and no pair, whatever a question's contexts. A vector without
    length is like nothing (0). (qid, sid) names a sentence.
    """
    spark, own = sentences.sparkSession, "sid" in contexts.columns
    rows = sentences.select("qid", "sid", F.col("v").cast("array<double>").alias("v")).dropDuplicates(["qid", "sid"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = contexts.select("qid", F.col("v").cast("array<double>").alias("v"), *(["sid"] if own else []))
    found = spark.createDataFrame([], f"qid {kinds['qid']}, sid {kinds['sid']}, best double")

    def held_against(block: list) -> DataFrame:
        groups: dict[object, list[int]] = {}
        for i, r in enumerate(block):
            groups.setdefault(r["qid"], []).append(i)
        made = {q: _Question(at, [block[i]["sid"] for i in at], [block[i]["v"] for i in at]) for q, at in groups.items()}
        names = spark.createDataFrame([(i, r["qid"], r["sid"]) for i, r in enumerate(block)], f"n int, qid {kinds['qid']}, sid {kinds['sid']}")
        held = spark.sparkContext.broadcast((made, len(block)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions, n = held.value
            best = np.full(n, -np.inf)
            for batch in batches:
                at: dict[object, list[int]] = {}
                for i, q in enumerate(batch.column(0).to_pylist()):
                    if q in questions:
                        at.setdefault(q, []).append(i)
                for q, rows in at.items():
                    part = pa.array(rows)
                    x = np.array(batch.column(1).take(part).to_pylist(), dtype=np.float64)
                    questions[q].hold(best, x, np.array(batch.column(2).take(part).to_pylist(), dtype=object) if own else None)
            some = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(best[some])], names=["m", "best"])

        near = columns.mapInArrow(run, "m int, best double").groupBy("m").agg(F.max("best").alias("best"))
        return names.join(near, F.col("n") == F.col("m"), "left").select("qid", "sid", "best")

    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append(r)
        size += 8 * len(r["v"])
        if size >= BLOCK_BYTES:
            found = found.unionByName(held_against(block))
            block, size = [], 0
    return found.unionByName(held_against(block)) if block else found
