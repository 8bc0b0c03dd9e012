"""Every query with SQL against DuckDB at the smallest size, and run plans on small fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom import queries as Q, run_queries
from fathom.operators.answers import FirstSentences, answer_rows
from fathom.operators.corpus import chunk_corpus
from fathom.operators.retrieve import ask
from fathom.plans import experiments, runs

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n, f in Q.QUERIES.items() if f.__module__ == run_queries.__name__ and n in Q.SQL) + ["bm25_stats", "chunk_line", "normalised_text", "entity_recall", "exact_match", "faithfulness_vec"]


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return held


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    found = con.execute(Q.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)


def test_answers_find_their_query_by_text(spark):
    answers = spark.createDataFrame([("s", " Who IS it? ", "It is Ada Lovelace.", ""), ("s", "Unknown?", "x", ""), ("s", None, "x", ""), ("s", "What then", "", "Short view")], "setting string, query string, answer_full string, answer_preview string")
    asked = spark.createDataFrame([("1", "who is it", "OTHER"), ("2", "Who is it!", "FACT"), ("3", "What, then?", None)], "query_id string, query string, query_type string")
    truths = spark.createDataFrame([("2", "It is Ada Lovelace."), ("9", "y")], "query_id string, ground_truth_answer string")
    keys = spark.createDataFrame([("2", "ada", "Ada; Byron ;")], "query_id string, short_answer string, key_entities string")
    from fathom.operators.embed import HashedTf

    got = {r["query_id"]: r for r in runs.answer_correctness(answers, asked, truths, keys, HashedTf()).collect()}
    assert set(got) == {2, 3}
    assert (got[2]["query_type"], got[2]["exact_match"], got[2]["entity_recall"]) == ("FACT", 1, 0.5)
    assert got[2]["semantic_similarity"] == pytest.approx(1.0, abs=1e-5)
    assert (got[3]["query_type"], got[3]["short_answer"], got[3]["answer_preview"], got[3]["exact_match"], got[3]["semantic_similarity"]) == ("", "", "Short view", 0, 0.0)


def test_corpus_of_both_kinds(spark):
    text = spark.createDataFrame([("b.txt", "\n\nCHAPTER ONE\nA few words.\n\nMore words.")], "source_file string, text string")
    code = spark.createDataFrame([("c.py", "import os\n\n\ndef f():\n    return 1\n")], "source_file string, text string")
    kinds = lambda mode: [(r["source_file"], r["source"]) for r in chunk_corpus(text, code, mode, 200, 0).select("source_file", "source").distinct().orderBy("source_file").collect()]
    assert kinds("fixed") == kinds("line") == kinds("token") == [("b.txt", None), ("c.py", "code")]
    assert kinds("structure_text") == [("b.txt", None)] and kinds("structure_code") == [("c.py", "code")]
    assert kinds("nonsense") == []
    made = chunk_corpus(text, code, "structure_code", 200, 0).where("metadata.node_type is not null")
    assert made.count() and made.columns[-1] == "metadata"


def test_asking_with_a_generator(spark):
    chunks = spark.createDataFrame([(1, "Cats sleep. Dogs bark loudly. Birds sing.", "en"), (2, "Hunde bellen laut.", "de")], "doc long, text string, lang string")
    asked = spark.createDataFrame([(1, "dogs bark"), (2, "nothing here")], "qid long, query string")
    got = {r["qid"]: r for r in ask(chunks, asked, 1, {"lang": "en"}, "bm25", "generate").collect()}
    assert got[1]["answer"] == "Cats sleep. Dogs bark loudly. Birds sing." and got[1]["sources"] == ["1"] and got[1]["error"] is None
    assert FirstSentences(1)("<passages>\n[1] One. Two.\n</passages>") == "One."
    with pytest.raises(ValueError, match="answer mode"):
        answer_rows(asked, "loud")


def test_a_full_run(spark):
    docs = spark.createDataFrame([("a", "red apples grow here. " * 30), ("b", "blue boats sail far. " * 30), ("c", "green grass waves on. " * 90)], "doc_id string, text string")
    asked = spark.createDataFrame([("q1", "apples"), ("q2", "boats"), ("q3", "none")], "qid string, query string")
    gold = spark.createDataFrame([("q1", "a"), ("q2", "b")], "qid string, doc_id string")
    made = experiments.full_run(docs, asked, gold, [("fixed", 64), ("token", 16)], k=2, overlap=4)
    summary = {r["setting"]: r for r in made["summary"].collect()}
    assert set(summary) == {"fixed_64", "token_16"} and all(r["hit_rate_at_1"] == 1.0 and r["skipped_queries"] == 1 for r in summary.values())
    assert made["answers"].count() == 6 and made["structure"].count() == 2
    arms = experiments.metadata_ablation(docs.select(F.col("doc_id").alias("doc"), "text", F.lit("berries").alias("topic")), asked.withColumn("query", F.lit("berries]")), 1)
    assert {r["arm"] for r in arms.collect()} == {"plain", "header"}
