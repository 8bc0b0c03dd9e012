"""What queries return over all rows, against plain Python."""

from collections import defaultdict

import duckdb
import pytest

from fathom import queries as Q
from fathom.functions.text import normalise_text
from fathom.operators import metrics

SF = "/root/testdata/sf0.01"


def turns(spark):
    return {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def pairs(spark):
    rows = turns(spark)
    return {k: (r["text"], rows[c, t + 1]["text"]) for k, r in rows.items() for c, t in [k] if r["role"] == "user" and (c, t + 1) in rows and rows[c, t + 1]["role"] == "assistant"}


def test_entities_are_normalised_like_answers(spark):
    rows = [("the fiancée came", "the", ["fiancée", "Café", "CAME", None]), ("plain", "x", ["plain"]), (None, None, None)]
    got = metrics.correctness_by_query(spark.createDataFrame(rows, "answer string, short_answer string, key_entities array<string>")).collect()
    assert [r["entity_recall"] for r in sorted(got, key=lambda r: str(r["answer"]))] == [0.0, 1.0, 0.5]


def test_every_turn_is_normalised(spark):
    got = {(r["conv_id"], r["turn"]): r["norm"] for r in Q.QUERIES["normalised_text"](spark, SF).collect()}
    assert got == {k: normalise_text(r["text"]) for k, r in turns(spark).items()}
    assert any(not r["text"].isascii() for r in turns(spark).values())


def correctness(question, answer):
    held = normalise_text(answer)
    short, keys = answer.split(" ")[0], question.split()[:4]
    return int(bool(short) and normalise_text(short) in held), round(sum(normalise_text(k) in held for k in keys) / len(keys), 6) if keys else 0.0


def test_every_pair_is_judged(spark):
    want = {k: correctness(*p) for k, p in pairs(spark).items()}
    got = {(r["conv_id"], r["turn"]): (r["exact_match"], r["entity_recall"]) for r in Q.QUERIES["entity_recall"](spark, SF).collect()}
    assert got == want and any(not q.isascii() or not a.isascii() for q, a in pairs(spark).values())
    by = defaultdict(list)
    for (c, t), (match, _) in want.items():
        by[c % 3].append((match, t < 2))
    mean = lambda x: sum(x) / len(x) if x else 0.0
    for r in Q.QUERIES["exact_match"](spark, SF).collect():
        rows = by.pop(r["setting"])
        assert r["queries"] == len(rows) and r["exact_match"] == pytest.approx(mean([m for m, _ in rows]), abs=1e-6)
        assert r["fact_exact_match"] == pytest.approx(mean([m for m, fact in rows if fact]), abs=1e-6)
    assert not by


@pytest.mark.parametrize("block", [2000, 2])
def test_short_items_find_their_gold(spark, tmp_path, monkeypatch, block):
    """Items of no to seven words, against the queries' own SQL."""
    monkeypatch.setattr(Q, "SHORT_ITEMS", block, raising=False)
    docs = [(0, "one two three four five six seven eight"), (1, "xone twoy"), (2, "three  four five"), (3, None), (4, "seven"), (5, "")]
    items = ["one", "one two", "two three four", "three four five six", "two three four five six", "one two three four five six", "two three four five six seven eight", "four five", "absent words", "", None]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(f"WITH {Q.GOLD} SELECT DISTINCT qid, doc_id FROM gold")
    assert sorted((r["qid"], r["doc_id"]) for r in Q._gold(spark, str(tmp_path)).collect()) == sorted(rel.fetchall())
    got = sorted((r["qid"], r["skipped"], r["n_gold"]) for r in Q.skipped_queries(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(Q.SQL["skipped_queries"]).fetchall())
    if block > 2:
        rel = con.sql(Q.SQL["hit_mrr_ndcg_sparse"])
        want = dict(zip(rel.columns, rel.fetchall()[0], strict=True))
        assert Q.hit_mrr_ndcg_sparse(spark, str(tmp_path)).first().asDict() == pytest.approx(want)


def test_sentences_are_held_against_all_other_vectors(spark):
    schema = "qid long, sid long, v array<double>"
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 100, [1.0, 0.0]), (2, 101, [1.0, 0.1]), (3, 200, [1.0, 0.0])], schema)
    got = {r["qid"]: r["faithfulness"] for r in metrics.faithfulness(rows.where("sid % 100 = 0"), rows).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0}
