"""Relevance, and the metrics of retrieval, structure, generation and correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions.text import basename, holds, looks_truncated, starts_orphaned


def as_list(value: Column) -> Column:
    """A list without blanks; null is no items."""
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def chunk_key(paragraph_id: Column, source_file: Column, chunk_id: Column) -> Column:
    fallback = F.concat(F.coalesce(source_file, F.lit("Unknown")), F.lit("::chunk_"), F.coalesce(chunk_id.cast("string"), F.lit("-1")))
    return F.coalesce(F.nullif(paragraph_id, F.lit("")), fallback)


def symbol_matches(symbol: Column, parent: Column, text: Column, strict: bool = False) -> Column:
    """Class.method is looked for in the parent only; a plain name in parent or text, as a word.
    ``strict`` wants the parts of a dotted symbol whole."""
    parts = F.split(symbol, r"\.")
    cls, method = F.concat(F.lit("class:"), F.element_at(parts, 1)), F.concat(F.lit("function:"), F.element_at(parts, -1))
    scope = F.coalesce(parent, F.lit(""))
    if strict:
        labels = F.split(scope, " > ")
        dotted = F.array_contains(labels, cls) & F.array_contains(labels, method)
    else:
        dotted = F.contains(scope, cls) & F.contains(scope, method)
    word = F.concat(F.lit(r"\b\Q"), symbol, F.lit(r"\E\b"))
    return F.when(F.contains(symbol, F.lit(".")), dotted).otherwise(F.regexp(scope, word) | F.regexp(F.coalesce(text, F.lit("")), word))


def is_relevant(key: Column, source_file: Column, parent: Column, text: Column, gold_ids: Column, gold_symbols: Column, gold_sources: Column, strict: bool = False) -> Column:
    """By id; else by symbol, if any are given; else by file name."""
    by_symbol = F.exists(as_list(gold_symbols), lambda s: symbol_matches(s, parent, text, strict))
    by_source = F.exists(as_list(gold_sources), lambda s: basename(s) == basename(source_file))
    found = F.when(F.array_contains(as_list(gold_ids), key), True).when(F.size(as_list(gold_symbols)) > 0, by_symbol).otherwise(by_source)
    return F.coalesce(found, F.lit(False))


def retrieval_by_query(ranked: DataFrame, k: int, ndcg_k: int = 10, by: list[str] | None = None) -> DataFrame:
    """(qid, hit_1, hit_k, reciprocal_rank, ndcg) from (qid, rank, relevant), each with the columns
    ``by``. The ideal order is that of the retrieved relevances; without a relevant one the gain is 0."""
    keys = [*(by or []), "qid"]
    top = ranked.where(F.col("rank") <= k).withColumn("rel", F.col("relevant").cast("int"))
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rel"), "rank"))
    top = top.withColumn("best", ideal)
    gain = lambda place: F.sum(F.when(F.col(place) <= ndcg_k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(place) + F.lit(1.0))).otherwise(0.0))
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    return top.groupBy(*keys).agg(
        F.coalesce(first == 1, F.lit(False)).cast("double").alias("hit_1"),
        first.isNotNull().cast("double").alias("hit_k"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.try_divide(gain("rank"), gain("best")), F.lit(0.0)).alias("ndcg"),
    )


def retrieval_summary(by_query: DataFrame, queries: DataFrame, gold: str = "gold", by: list[str] | None = None) -> DataFrame:
    """Means over the queries with gold, and how many were skipped; 0 without any. One row, or one for
    each value of the columns ``by`` of ``by_query``."""
    asked = queries.select("qid", (F.size(gold) > 0).alias("judged"))
    keys = by or []
    if keys:
        asked = asked.join(F.broadcast(by_query.select(*keys).distinct()))  # a row for each value
    both = asked.join(by_query, [*keys, "qid"], "left")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("judged"), F.coalesce(c, F.lit(0.0)))), F.lit(0.0)), 6)
    return both.groupBy(*keys).agg(
        F.count("*").alias("total_queries"),
        F.count_if("judged").alias("evaluated_queries"),
        F.count_if(~F.col("judged")).alias("skipped_queries"),
        mean("hit_1").alias("hit_rate_at_1"),
        mean("hit_k").alias("hit_rate_at_k"),
        mean("reciprocal_rank").alias("mrr"),
        mean("ndcg").alias("ndcg_at_k"),
    )


def structure_metrics(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Boundary and context ratios of chunks (text, boundary_truncated, context_augmented); a flag,
    where set, decides, else how the text ends."""
    cut = F.coalesce(F.col("boundary_truncated"), looks_truncated(F.coalesce("text", F.lit(""))))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunk_count"),
        F.round(F.avg(cut.cast("int")), 6).alias("boundary_truncation_ratio"),
        F.round(F.avg(F.coalesce(F.col("context_augmented"), F.lit(False)).cast("int")), 6).alias("context_augmentation_ratio"),
        F.count("boundary_truncated").alias("explicit_boundary_flags"),
    )


def integrity_metrics(chunks: DataFrame, by: list[str], check_syntax: bool = True) -> DataFrame:
    """Share of code chunks that don't parse and that start as orphans; is_orphan, where set, decides."""
    from fathom.operators.code import code_parses

    orphan = F.coalesce(F.col("is_orphan"), starts_orphaned(F.coalesce("text", F.lit("")))).cast("int")
    broken = (~code_parses(F.col("text"))).cast("int") if check_syntax else F.lit(0)
    flags = chunks.select(*by, orphan.alias("orphan"), broken.alias("broken"))
    return flags.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum("broken").alias("syntax_error_count"),
        F.sum("orphan").alias("orphan_count"),
        F.round(100 * F.avg("broken"), 4).alias("syntax_error_pct"),
        F.round(100 * F.avg("orphan"), 4).alias("orphan_pct"),
    )


def faithfulness(answers: DataFrame, contexts: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(qid, faithfulness): of an answer's sentence vectors (qid, sid, v), the share that some context
    vector (qid, v) of the query comes near to; 0 without contexts. Contexts with a ``sid`` are no
    context of the sentence of that sid. No pair of both is ever a row (``most_similar``)."""
    from fathom.operators.similar import most_similar

    near = F.coalesce(F.round("best", 9) >= threshold, F.lit(False))
    return most_similar(answers, contexts).groupBy("qid").agg(F.round(F.avg(near.cast("int")), 6).alias("faithfulness"))


def correctness_by_query(rows: DataFrame) -> DataFrame:
    """``rows`` (answer, short_answer, key_entities) with exact_match and entity_recall; an entity is
    found if the normalised answer contains it, normalised alike."""
    from fathom.functions.text import normalise, normalise_each

    held = rows.withColumn("__answer", normalise(F.coalesce("answer", F.lit("")))).withColumn("__entities", normalise_each(F.col("key_entities")))
    found = F.filter("__entities", lambda e: F.contains(F.col("__answer"), e))
    recall = F.coalesce(F.try_divide(F.size(found), F.size("key_entities")), F.lit(0.0))
    return held.withColumn("exact_match", holds(F.col("answer"), F.col("short_answer")).cast("int")).withColumn("entity_recall", recall).drop("__answer", "__entities")


def correctness_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of exact_match and entity_recall, overall and over FACT queries (0 without any)."""
    fact = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("query_type") == "FACT", F.col(c))), F.lit(0.0)), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("queries"),
        F.round(F.avg("exact_match"), 6).alias("exact_match"),
        fact("exact_match").alias("fact_exact_match"),
        F.round(F.avg("entity_recall"), 6).alias("entity_recall"),
        fact("entity_recall").alias("fact_entity_recall"),
    )
