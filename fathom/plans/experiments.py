"""Grids of chunking settings over one corpus, in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fathom.operators import bm25
from fathom.operators.chunk_counts import COUNTS, chunk_counts
from fathom.operators.chunkers import chunk_texts
from fathom.operators.classify import inject_header
from fathom.operators.metrics import retrieval_by_query, retrieval_summary, structure_metrics
from fathom.operators.retrieve import answered, ask
from fathom.plans.ledger import Ledger
from fathom.runtime import materialize

#: The grids of the two text experiments; sizes in characters, for tokens in tokens.
E1 = [(m, 256) for m in ("fixed", "token", "structure_text")]
E2 = [(m, s) for m in ("fixed", "structure_text") for s in (64, 128, 256, 512)]
OVERLAP = 50


def chunk_grid(docs: DataFrame, settings: Sequence[tuple[str, int]], overlap: int = OVERLAP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of every setting, with its mode, size and name as columns."""
    each = [chunk_texts(docs, m, s, overlap, id_col, text).select(F.lit(f"{m}_{s}").alias("setting"), F.lit(m).alias("chunk_mode"), F.lit(s).alias("chunk_size"), "*") for m, s in dict.fromkeys(settings)]
    return reduce(DataFrame.unionByName, each)


def structure_report(chunks: DataFrame) -> DataFrame:
    return structure_metrics(chunks, ["setting"])


def grid_report(docs: DataFrame, settings: Sequence[tuple[str, int]], overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """``structure_report`` of ``chunk_grid``, without the chunks: texts are read once for all settings,
    and counts are all that leaves a worker."""
    sums = chunk_counts(docs, settings, overlap, text).groupBy("setting").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("chunk_count > 0")
    ratio = lambda c: F.round(F.col(c) / F.col("chunk_count"), 6)
    return sums.select("setting", "chunk_count", ratio("cut").alias("boundary_truncation_ratio"), ratio("augmented").alias("context_augmentation_ratio"), F.col("flagged").alias("explicit_boundary_flags"))


def retrieval_report(chunks: DataFrame, queries: DataFrame, gold: DataFrame, settings: Sequence[str], k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(setting, qid, metrics): text retrieval over each setting's chunks against gold (qid, id).

    One index holds all settings, with statistics by setting: chunks are read once, whatever their number."""
    held = chunks.where(F.col("setting").isin(*settings)).select("setting", F.struct(id_col, "pos").alias("doc"), "text")
    ranked = bm25.top(bm25.build_index(held, "doc", by="setting"), queries, k).withColumn(id_col, F.col(f"doc.{id_col}"))
    right = ranked.join(gold.select("qid", id_col).distinct().withColumn("ok", F.lit(True)), ["qid", id_col], "left")
    return retrieval_by_query(right.select(F.col("grp").alias("setting"), "qid", "rank", F.coalesce("ok", F.lit(False)).alias("relevant")), k, by=["setting"])


def answer_sweep(chunks: DataFrame, queries: DataFrame, settings: Sequence[str], k: int = 3, method: str = "hybrid", mode: str = "extractive", make=None, **options: object) -> DataFrame:
    """(setting, qid, query, answer, sources, error): every question answered from each setting's chunks
    (setting, doc, text); ``options`` are those of ``ask``. With ``method="bm25"`` and no filter one
    index holds all settings; else each setting is asked by itself."""
    if method != "bm25" or options:
        each = [ask(chunks.where(F.col("setting") == s).drop("setting"), queries, k, method=method, mode=mode, make=make, **options).select(F.lit(s).alias("setting"), "*") for s in settings]
        return reduce(DataFrame.unionByName, each)
    held = chunks.where(F.col("setting").isin(*settings)).select("setting", "doc", "text")
    ranked = bm25.top(bm25.build_index(held, "doc", by="setting"), queries, k).withColumnRenamed("grp", "setting")
    found = ranked.join(held, ["setting", "doc"]).groupBy("setting", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "text"))).alias("x"))
    pairs = F.struct(F.col("setting").alias("setting"), F.col("qid").alias("qid"))
    named = queries.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(settings)], "setting string")
    rows = queries.select("qid", "query").join(F.broadcast(named)).join(found, ["setting", "qid"], "left")
    said = answered(rows.select(pairs.alias("qid"), "query", "x"), mode, make)
    return said.select("qid.setting", "qid.qid", "query", "answer", "sources", "error")


def metadata_ablation(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(arm, qid, doc, rank): text retrieval over chunks (doc, text, metadata) as they are (plain) and
    with their metadata in front of the text (header); one index, with statistics by arm."""
    arms = {"plain": chunks, "header": inject_header(chunks)}
    both = reduce(DataFrame.unionByName, [c.select(F.lit(arm).alias("arm"), "doc", "text") for arm, c in arms.items()])
    return bm25.top(bm25.build_index(both, "doc", by="arm"), queries, k).select(F.col("grp").alias("arm"), "qid", "doc", "rank")


def full_run(docs: DataFrame, queries: DataFrame, gold: DataFrame, settings: Sequence[tuple[str, int]], k: int = 5, overlap: int = OVERLAP, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """The stages of an experiment as tables: chunks, structure, retrieval, its means by setting, answers.

    Chunks are written to the shared folder once; all that follows reads them."""
    chunks = materialize(chunk_grid(docs, settings, overlap, id_col), "chunks")
    names = [f"{m}_{s}" for m, s in dict.fromkeys(settings)]
    retrieval = retrieval_report(chunks, queries, gold, names, k, id_col)
    per = queries.select("qid").join(gold.groupBy("qid").agg(F.collect_list(id_col).alias("gold")), "qid", "left").withColumn("gold", F.coalesce("gold", F.array()))
    means = retrieval_summary(retrieval, per, by=["setting"])
    held = chunks.select("setting", F.struct(id_col, "pos").alias("doc"), "text")
    return {"chunks": chunks, "structure": structure_report(chunks), "retrieval": retrieval, "summary": means, "answers": answer_sweep(held, queries, names, method="bm25")}


def resumed_grid(docs: DataFrame, settings: Sequence[tuple[str, int]], folder: str, overlap: int = OVERLAP, id_col: str = "doc_id", text: str = "text") -> Ledger:
    """Chunk every setting of a grid that a run into ``folder`` hasn't finished yet; the run's ledger.

    A run that was stopped goes on with the setting that it was at; finished ones aren't touched."""
    named = {f"{m}_{s}": (m, s) for m, s in settings}
    ledger = Ledger(docs.sparkSession, folder)
    ledger.run(named, lambda name: chunk_texts(docs, *named[name], overlap, id_col, text))
    return ledger
