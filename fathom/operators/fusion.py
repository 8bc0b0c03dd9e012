"""Reciprocal rank fusion of a vector and a text ranking, in three variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (k + rank)


def search_depth(k: int) -> int:
    """Candidates of each arm: ten times what is asked for, a thousand at least; fewer if there are no more."""
    return max(10 * k, 1000)


def fuse_by_position(vector: DataFrame, text: DataFrame, depth: int, k: int | None = None, passing: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, rank) of arms (qid, doc, rank from 1); ranks count from 0 in the score.

    ``passing`` (doc) filters what is fused, after fusion. Ties keep the vector arm's order, then the
    text arm's.
    """
    v = vector.where(F.col("rank") <= depth).select("qid", "doc", (F.col("rank") - 1).alias("v"))
    t = text.where(F.col("rank") <= depth).select("qid", "doc", (F.col("rank") - 1).alias("t"))
    both = v.join(t, ["qid", "doc"], "full_outer")
    score = F.coalesce(rrf(F.col("v")), F.lit(0.0)) + F.coalesce(rrf(F.col("t")), F.lit(0.0))
    both = both.withColumn("score", F.round(score, 9)).withColumn("seen", F.coalesce("v", F.lit(depth) + F.col("t")))
    if passing is not None:
        both = both.join(passing.select("doc"), "doc", "left_semi")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    out = both.withColumn("rank", F.row_number().over(order))
    return (out if k is None else out.where(F.col("rank") <= k)).select("qid", "doc", "score", "rank")


def fuse_by_content(vector: DataFrame, text: DataFrame, contents: DataFrame, k: int = 5) -> DataFrame:
    """(qid, content, doc, score, rank): ranks count from 1, equal contents are one and their scores
    add up; ``doc`` is the one seen last. Arms are (qid, doc, rank), contents (doc, content)."""
    arms = vector.where(F.col("rank") <= k).select("qid", "doc", "rank", F.lit(0).alias("arm")).unionByName(text.where(F.col("rank") <= k).select("qid", "doc", "rank", F.lit(1).alias("arm")))
    named = arms.join(contents, "doc").withColumn("seen", F.col("arm") * F.lit(k) + F.col("rank"))
    total = named.groupBy("qid", "content").agg(F.round(F.sum(rrf(F.col("rank"))), 9).alias("score"), F.min("seen").alias("seen"), F.max_by("doc", "seen").alias("doc"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "content", "doc", "score", "rank")


def fuse_explained(vector: DataFrame, text: DataFrame, contents: DataFrame, k: int = 5, depth: int | None = None) -> DataFrame:
    """(qid, content, doc, vector_score, text_score, score, rank, vector_ratio, text_ratio): each
    arm's part, and its share in all returned rows of the query (0 where the total is 0)."""
    depth = depth or k
    arms = vector.where(F.col("rank") <= depth).select("qid", "doc", "rank", F.lit("v").alias("arm")).unionByName(text.where(F.col("rank") <= depth).select("qid", "doc", "rank", F.lit("t").alias("arm")))
    named = arms.join(contents, "doc").withColumn("seen", F.when(F.col("arm") == "v", F.col("rank")).otherwise(F.col("rank") + depth))
    part = lambda arm: F.round(F.sum(F.when(F.col("arm") == arm, rrf(F.col("rank"))).otherwise(0.0)), 9)
    total = named.groupBy("qid", "content").agg(part("v").alias("vector_score"), part("t").alias("text_score"), F.min("seen").alias("seen"), F.min_by("doc", "seen").alias("doc"))
    total = total.withColumn("score", F.round(F.col("vector_score") + F.col("text_score"), 9))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    whole = Window.partitionBy("qid")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.sum(c).over(whole), F.sum("score").over(whole)), F.lit(0.0)), 6)
    return best.select("qid", "content", "doc", "vector_score", "text_score", "score", "rank", share("vector_score").alias("vector_ratio"), share("text_score").alias("text_ratio"))
