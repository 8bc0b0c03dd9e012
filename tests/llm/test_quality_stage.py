import math
import re

from pyspark.sql import functions as F

from fathom.llm import quality
from fathom.llm.quality import judge_quality, keep_good
from tests.llm import brute

SF = "/root/testdata/sf0.1"


def test_stage_keeps_what_the_query_keeps(spark):
    """Rows that fail the base rules tell the model of bad documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r["doc_id"] for r in judge_quality(docs).where("kept").select("doc_id").collect())
    rows = keep_good(docs)
    assert rows.columns == docs.columns and kept
    assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == kept


def plain_quality(texts, steps=25):
    """Figures, votes, expectation-maximisation and posteriors over single documents."""
    votes = []
    for t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars, symbols, twice, again, *_ = brute.quality_figures(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        count = lambda p, t=t: len(re.findall(p, t))
        ends, edges = count(r"[.?](?=[\x20\n]|\Z)"), count(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\Z)")
        plain = sum(re.fullmatch(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+[.,;:?]?", x) is not None for x in w)
        capitals, shouts, distinct = count("[A-Z]{2}"), t.count("!"), len(set(w))
        mean = chars / n if n else 0
        rules = [
            (10 * symbols >= n, 50 * symbols <= n), (10 * edges >= n, 50 * edges <= n), (4 * plain <= 3 * n, 20 * plain >= 19 * n), (4 * capitals >= n, 20 * capitals <= n), (10 * shouts >= n, 50 * shouts <= n),
            (4 * twice >= max(len(lines), 2), twice == 0), (10 * again > 3 * n, 50 * again <= n), (n >= 20 and distinct * 5 <= n, distinct * 3 >= n), (mean < 2.5 or mean > 15, 3 <= mean <= 10), (n >= 40 and 100 * ends < n, n >= 40 and 40 * ends >= n),
        ]
        votes.append([0 if not n else -1 if bad else 1 if good else 0 for bad, good in rules])
    prior, rates = 0.8, [(0.02, 0.3)] * 10

    def posterior(v):
        odds = math.log(prior / (1 - prior))
        for x, (f, g) in zip(v, rates, strict=True):
            odds += math.log((1 - f) / (1 - g)) if x == 1 else math.log(f / g) if x == -1 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(steps):
        p = [posterior(v) for v in votes]
        fresh = []
        for j in range(10):
            f, g = ((sum(q for q, v in zip(of, votes, strict=True) if v[j] == -1) + 20 * start) / (sum(q for q, v in zip(of, votes, strict=True) if v[j]) + 20) for of, start in ((p, 0.02), ([1 - q for q in p], 0.3)))
            fresh.append((f, max(f, g)))
        prior, rates = (sum(p) + 16) / (len(p) + 20), fresh

    def verdict(v):
        odds = math.log(prior / (1 - prior))
        for family in ((0, 1, 2), (3, 4), (5,), (6, 7), (8,), (9,)):
            noisy = {j: [0.01 + 0.98 * r for r in rates[j]] for j in family}
            said = [math.log((1 - noisy[j][0]) / (1 - noisy[j][1])) if v[j] == 1 else math.log(noisy[j][0] / noisy[j][1]) for j in family if v[j]]
            odds += sum(said) / max(1, len(said))
        return 1 / (1 + math.exp(-odds))

    return [verdict(v) for v in votes]


def test_one_bad_vote_does_not_sink_a_document(spark):
    """With the rates of a whole table: any single bad vote among good ones is outweighed, a family isn't."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    figures = docs.select(*[c.alias(n) for n, c in quality.text_figures(docs).items()]).select(F.array(*quality.votes()).alias("votes"))
    model = quality.rule_model(figures, 10).collect()[0]
    patterns = [[-1 if i in bad else 1 for i in range(10)] for bad in [*[(j,) for j in range(10)], (0, 1, 2), (3, 4, 9), (6, 7), (7, 9)]]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "votes array<int>, n int")
    judged = rows.withColumn("q", quality._verdict(F.lit(model["prior"]), F.array(*[F.struct(*[F.lit(w[c]).alias(c) for c in ("false", "true")]) for w in model["weights"]]), F.col("votes")))
    got = [r["q"] for r in judged.orderBy("n").collect()]
    assert all(q > 0.5 for q in got[:10]) and all(q < 0.5 for q in got[10:]), got


def test_labels_that_shaped_no_rule(spark):
    """Good documents stay and bad ones go, on a table whose labels no rule was made with."""
    held = "/root/testdata/check_s"
    labels = spark.read.parquet(f"{held}/labels.parquet").select("doc_id", F.col("quality").alias("quality_label"))
    judged = judge_quality(spark.read.parquet(f"{held}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    counts = {(r["label"], r["kept"]): r["n"] for r in judged.groupBy(F.col("quality_label").alias("label"), "kept").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, True), 0)
    assert good >= 0.99 * (good + counts.get((1, False), 0)) and bad <= 0.05 * (bad + counts[0, False]), counts


def test_posteriors_match_plain_estimation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "! " * 60), (-3, "! " * 60)]
    got = sorted((r["doc_id"], r["quality"], r["kept"], r["base_failed"]) for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted(zip([d for d, _ in rows], plain_quality([t for _, t in rows]), strict=True))
    for (d, q, kept, failed), (e, p) in zip(got, want, strict=True):
        assert d == e and abs(q - p) < 1e-6 and kept == (not failed and p >= 0.5), d
