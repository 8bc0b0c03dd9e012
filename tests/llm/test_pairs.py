import random

import numpy as np
import pytest

from fathom.llm.components import components
from fathom.llm.jaccard import gram_set, jaccard_components, keep_one_of_each
from fathom.llm.suffix_dedup import string_digests
from fathom.llm.suffixes import suffix_array
from tests.llm import brute


def texts(seed):
    """Copies, near copies on both sides of the threshold, shared passages, odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, out = make(30), []
    for _ in range(6):
        base = make(r.choice([40, 120, 300]))
        out.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for _ in range(r.randint(0, len(base) // 12)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.3:
                own = own[: -r.randint(1, len(own) // 6)]
            out.append(" ".join(own))
    out += [" ".join(make(40) + passage + make(r.randint(0, 60))) for _ in range(12)]
    out += [None, "", " \n", "one", "ONE", "one two three four", "a b c d e", "A b c d e", "é" * 70, "é" * 90, "x" * 49, "x" * 50, "x" * 51, "ab" * 60, "y" + "ab" * 60]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, n long, component_id string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert sorted(map(tuple, jaccard_components(frame(spark, rows)).collect())) == brute.jaccard_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_strings_of_earlier_documents_go(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert sorted(map(tuple, string_digests(frame(spark, rows)).collect())) == sorted(brute.suffix_dedup(rows))


def test_hot_anchors_deal_strings_one_by_one(spark, monkeypatch):
    monkeypatch.setattr("fathom.llm.suffix_dedup.HOT", 3)
    monkeypatch.setattr("fathom.llm.suffix_dedup.BLOCK", 500)
    rows = list(enumerate(texts(3)))
    assert sorted(map(tuple, string_digests(frame(spark, rows)).collect())) == sorted(brute.suffix_dedup(rows))


@pytest.mark.parametrize("run", [jaccard_components, string_digests, keep_one_of_each])
def test_empty_repeated_and_null(spark, run):
    empty = frame(spark, [(1, "x")]).where("false")
    assert run(empty).count() == 0
    same = [(1, "a b c d e f " * 10), (1, "a b c d e f " * 10), (None, None), (None, "other words here"), (2, "a b c d e f " * 10)]
    out = run(frame(spark, same)).collect()
    if run is keep_one_of_each:
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out if r["doc_id"]) == [(False, 1)]
    elif run is jaccard_components:
        assert {r["component_id"] for r in out if r["doc_id"]} == {1} and len(out) == 5
    else:
        assert sorted(r["n_removed"] for r in out) == [0, 0, 0, 0, 120]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"aab\0", b"abc \n", bytes(range(256))])
def test_suffix_array_sorts(alphabet):
    r = random.Random(5)
    b = bytes(r.choice(alphabet) for _ in range(700))
    order = suffix_array(np.frombuffer(b, dtype=np.uint8), 50)
    assert sorted(order.tolist()) == list(range(len(b)))
    cut = [b[i : i + 50] for i in order]
    assert cut == sorted(cut)


def test_gram_sets_follow_words():
    assert len(gram_set(None)) == len(gram_set(" \t\n")) == 0
    assert gram_set("A b").tolist() == gram_set("a\x0bB ").tolist() != gram_set("ab").tolist()
    assert len(gram_set("a b c d e f a b c d e f")) == 6
    assert len(gram_set("a b c d e f")) == 1
