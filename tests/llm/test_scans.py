import pytest

from fathom.llm.pii import pii_digests, scan_pii
from fathom.llm.quality import FIGURES, judge_quality
from fathom.llm.secrets import secret_digests
from tests.llm import brute

NASTY = [
    None, "", " ", "\n\n", "é" * 30 + "\U0001F600 token = abcdef1", "password: token: abcdefgh", "secret=token=abcdefgh", "Api_Key\":'AbC+/_.=-x'", "apikey = \"x\" token:  zzzzzz",
    "AKIA" + "A" * 16 + "AKIA" + "B" * 3, "xAKIAAKIA123", "0123456789abcdef01234567", "g0123456789abcdef0123456" + "89", "passwd='abc' passwd='abcdef'",
    "a@b.c_d@e.f", "x..y%+-@a-b.c.d. z@q", "@@a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.002.003.004", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111 1111 1111 1111 4111",
    "+1 (437) 555-0689 +12 +1 23456789", "++1.2.3.4567890", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "\U0001F600+49 30 1234567\U0001F600", "0" * 5000, "a." * 3000 + "@b.c", "9 " * 8000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, secrets string").repartition(3)


def test_secrets_match_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:5] for r in secret_digests(frame(spark, NASTY)).collect()}
    assert got == {i: brute.secrets(t) for i, t in enumerate(NASTY)}


def test_pii_matches_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii_digests(frame(spark, NASTY)).collect()}
    assert got == {i: brute.pii(t) for i, t in enumerate(NASTY)}


def test_weak_credentials_need_their_complement(spark):
    weak = "Zk3" + "aB9xQ" * 6
    texts = [f"key {weak} alone", f"AKIA{'Q' * 16} and {weak}", f"AKIA{'Q' * 16}" + " pad" * 200 + f" {weak}", "see https://db.example.com/x", f"https://db.example.com/x {weak}", "user = someone", "user = someone password = hunter22"]
    got = {r["doc_id"]: r["spans"] for r in secret_digests(frame(spark, texts)).collect()}
    assert got[0] == "" and got[3] == "" and got[5] == ""
    assert "random" in got[1] and "random" not in got[2]
    assert "endpoint:0:24" in got[4] and "random:25:" in got[4]
    assert "identity:0:14" in got[6] and "assign:15:34" in got[6]


def test_contexts_of_known_identifiers_find_unknown_ones(spark):
    texts = [f"intro words my mail person{i}@example.com rest" for i in range(8)] + ["then my mail AB-12345-CD rest", "other words here AB-12345-XY rest"]
    got = {r["doc_id"]: [(x["kind"], x["a"], x["b"]) for x in r["pii"]] for r in scan_pii(frame(spark, texts)).collect()}
    assert got[8] == [("found", 13, 24)] and got[9] == []
    assert all(k[0][0] == "email" for i, k in got.items() if i < 8)


@pytest.mark.parametrize("run", [secret_digests, pii_digests, judge_quality])
def test_empty_table_and_repeated_rows(spark, run):
    assert run(frame(spark, NASTY).where("false")).count() == 0
    twice = spark.createDataFrame([(1, "mail a@b.cd token=abcdef"), (1, "mail a@b.cd token=abcdef"), (None, None)], "doc_id long, text string")
    assert run(twice).count() == 3


def test_quality_figures_match_brute_force(spark):
    words = [f"w{i}" for i in range(40)]
    run = " ".join(words)
    texts = [*NASTY, run, run + " " + run, run + " x " + " ".join(words[5:14]), "a " * 100, "x\nx\n\n y\nx ", "\t".join(words[:19]), f"{run}\n" * 3, "é " * 30, " ".join(words[:8]) + " q " + " ".join(words[:8]) + " z " + " ".join(words[:12])]
    got = {r["doc_id"]: r for r in judge_quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in (*FIGURES, "base_failed")) == brute.quality_figures(t), i
        assert not (got[i]["base_failed"] and got[i]["kept"])
