"""Evaluation runs: which settings and queries count, answers against their keys, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.functions.text import normalise, parse_list
from fathom.functions.vectors import cosine
from fathom.operators.metrics import correctness_by_query
from fathom.operators.embed import Embedder


def allowed_mode(setting: Column, modes: Sequence[str]) -> Column:
    """Whether a setting's name starts with one of the modes and an underscore."""
    return reduce(lambda a, b: a | b, [setting.startswith(f"{m}_") for m in modes], F.lit(False))


def first_queries(rows: DataFrame, most: int, order: str) -> DataFrame:
    """The first ``most`` rows in order; 0 or less means all."""
    return rows.orderBy(order).limit(most) if most > 0 else rows


def bucket(kind: Column, known: Sequence[str]) -> Column:
    """A query type, or UNKNOWN if it is null or none of the known ones."""
    return F.when(kind.isin(*known), kind).otherwise("UNKNOWN")


def audit(rows: DataFrame, known: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """One row about rows (query_type, gold_sources, _error): how many are broken, valid and without
    gold, and how many valid ones each type has (map). One scan; rows with an error count nowhere else."""
    broken = F.col("_error").isNotNull()
    kind = bucket(F.col("query_type"), known)
    counts = [F.count_if(~broken & (kind == k)) for k in (*known, "UNKNOWN")]
    pairs = [x for k, c in zip((*known, "UNKNOWN"), counts, strict=True) for x in (F.lit(k), c)]
    bare = F.coalesce(F.size("gold_sources"), F.lit(0)) <= 0
    return rows.agg(F.count_if(broken).alias("errors"), F.count_if(~broken).alias("valid"), F.count_if(~broken & bare).alias("missing_gold"), F.create_map(*pairs).alias("types"))


def report_name(file: Column) -> tuple[Column, Column]:
    """(method, size) of a report's file: all but the last part of its name, and the last one."""
    name = F.replace(F.replace(F.element_at(F.split(file, "/"), -1), F.lit("eval_"), F.lit("")), F.lit(".json"), F.lit(""))
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_"), F.element_at(parts, -1)


SUMMARY = ("hit_rate_at_1", "hit_rate_at_k", "mrr", "ndcg_at_k")


def retrieval_summary(reports: DataFrame, file: str = "file") -> DataFrame:
    """(method, size, four metrics to four digits as text) of reports; a missing metric is 0."""
    method, size = report_name(F.col(file))
    metric = lambda c: F.col(c).cast("double") if c in reports.columns else F.lit(0.0)
    return reports.select(method.alias("method"), size.alias("size"), *[F.format_string("%.4f", F.coalesce(metric(c), F.lit(0.0))).alias(c) for c in SUMMARY])


def fallback_rates(chunks: DataFrame, by: Sequence[str] = ("chunk_size",)) -> DataFrame:
    """Share of chunks that were cut by force; a flag that isn't set counts as no."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.round(F.avg(F.coalesce(F.col("fallback_chunked"), F.lit(False)).cast("int")), 6).alias("fallback_rate"))


def executable_rates(integrity: DataFrame) -> DataFrame:
    """Integrity metrics with the share of chunks that parse."""
    return integrity.withColumn("executable_pct", F.round(100 - F.col("syntax_error_pct"), 4))


def answer_correctness(answers: DataFrame, queries: DataFrame, truths: DataFrame, entities: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(setting, query_id, query_type, query, short_answer, answer_preview, exact_match, entity_recall,
    semantic_similarity): answers held against their keys, by setting and number.

    ``answers`` (setting, query, answer_full, answer_preview) find their query by its normalised
    text; answers without a query text or without such a query don't count, and of queries with the
    same text the last by id stands. ``truths`` (query_id, ground_truth_answer) and ``entities``
    (query_id, short_answer, key_entities with ;) may lack a query: its keys are empty then. An
    entity counts as found if the normalised answer holds it. Similarity is the cosine of what
    ``embedder`` makes of answer and truth, 0 without a truth, and null without an embedder.
    """
    key = lambda c: normalise(F.coalesce(F.col(c), F.lit("")))
    known = queries.select(key("query").alias("__key"), F.col("query_id").cast("int").alias("query_id"), F.coalesce("query_type", F.lit("")).alias("query_type"))
    known = known.groupBy("__key").agg(F.max_by(F.struct("query_id", "query_type"), "query_id").alias("q")).select("__key", "q.*")
    truth = truths.groupBy(F.col("query_id").cast("int").alias("query_id")).agg(F.max("ground_truth_answer").alias("truth"))
    held = entities.groupBy(F.col("query_id").cast("int").alias("query_id")).agg(F.max_by(F.struct("short_answer", "key_entities"), F.coalesce("short_answer", F.lit(""))).alias("e")).select("query_id", "e.*")
    given = answers.where(F.coalesce("query", F.lit("")) != "").select("setting", "query", F.coalesce(F.nullif("answer_full", F.lit("")), "answer_preview", F.lit("")).alias("answer"), key("query").alias("__key"))
    rows = given.join(known, "__key").join(truth, "query_id", "left").join(held, "query_id", "left")
    rows = rows.withColumn("short_answer", F.coalesce("short_answer", F.lit(""))).withColumn("key_entities", parse_list(F.coalesce("key_entities", F.lit(""))))
    rows = correctness_by_query(rows)
    if embedder is None:
        rows = rows.withColumn("semantic_similarity", F.lit(None).cast("double"))
    else:
        both = embedder.embed(embedder.embed(rows.withColumn("truth", F.coalesce("truth", F.lit(""))), "answer", "__a"), "truth", "__t")
        rows = both.withColumn("semantic_similarity", F.when(F.col("truth") == "", 0.0).otherwise(F.round(cosine(F.col("__a"), F.col("__t")), 6)))
    return rows.select("setting", "query_id", "query_type", "query", "short_answer", F.left("answer", F.lit(300)).alias("answer_preview"), "exact_match", F.round("entity_recall", 6).alias("entity_recall"), "semantic_similarity")


def in_order(details: DataFrame) -> DataFrame:
    """Details by setting, and within it by the number of the query, not its text."""
    return details.orderBy("setting", F.col("query_id").cast("int"))


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows (qid, source_file, rank) with ``relevant``: whether (qid, source_file) is in ``qrels``."""
    right = qrels.select("qid", "source_file").distinct().withColumn("ok", F.lit(True))
    return ranked.join(right, ["qid", "source_file"], "left").withColumn("relevant", F.coalesce("ok", F.lit(False))).drop("ok")


def titled(pages: DataFrame, order: str, title: str = "title", text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """One text of all pages (of each value of ``by``) in order, each under a line with its title; pages
    without text are left out. A text is one row: this is for reports, not for corpora."""
    held = pages.where(F.coalesce(text, F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("=== "), F.col(title), F.lit(" ===\n"), F.col(text)).alias("part"))))
    return held.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("text"))


def open_settings(spark: SparkSession, modes: Sequence[str], sizes: Sequence[int], done: DataFrame) -> DataFrame:
    """(chunk_mode, chunk_size, setting) of a grid, without the settings that ``done`` has."""
    grid = spark.createDataFrame([(m, s, f"{m}_{s}") for m in modes for s in sizes], "chunk_mode string, chunk_size int, setting string")
    return grid.join(done.select("setting"), "setting", "left_anti").select("chunk_mode", "chunk_size", "setting")

