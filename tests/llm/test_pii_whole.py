import re

import pytest

from fathom.llm.pii import _before, scan_pii, trusted_patterns
from fathom.llm.sqltext import Sql


def plain(text, a):
    words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text[:a])
    return re.sub("[A-Z]", lambda m: m[0].lower(), "".join(words[-2:])).rstrip(" \t\n\x0b\x0c\r").lstrip(" \t\n\x0b\x0c\r")


@pytest.mark.parametrize("pad", [1, 40, 44, 45, 46, 47, 48, 60, 1000, 1020, 1024, 5000])
def test_context_is_two_whole_words_wherever_they_start(spark, pad):
    befores = ["", " " * pad, "SSN:" + " " * pad, "a My" + " " * pad + "mail ", "x my mail" + "\t" * pad, "q " + "W" * pad + " \u00e9 ", "\U0001F600 " + "b" * pad + " ", "p" * pad + " q ", "one two three\n"]
    rows = spark.createDataFrame([(b + "AB-12345", len(b)) for b in befores], "t string, a int")
    got = [r["c"] for r in rows.select(_before(Sql("left(t, a)"), Sql("left(t, a)")).alias("c").column()).collect()]
    assert got == [plain(b, len(b)) for b in befores]


def test_far_contexts_and_text_starts_find(spark):
    far, start = "my mail" + " " * 80, "Mail: "
    texts = [f"intro {far}p{i}@example.com x" for i in range(6)] + [f"{start}q{i}@example.com x" for i in range(6)] + [f"then {far}AB-12345-CD x", f"{start}AB-98765-CD x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["kind"] for x in r["pii"]] for r in scan_pii(docs).collect()}
    assert got[12] == ["found"] and got[13] == ["found"]


def test_trust_runs_until_it_settles(spark):
    """A chain of patterns, each of which trusts the next one's instances."""
    edges = [("c0", i, 1) for i in range(7)] + [("c0", 100 + i, 0) for i in range(3)]
    for k in range(1, 6):
        edges += [(f"c{k}", 100 * k + i, 0) for i in range(8)] + [(f"c{k - 1}", 100 * k + i, 0) for i in range(8)] * (k > 1)
    chain = [("p0", i, 1) for i in range(6)] + [("p0", 1000, 0)]
    for k in range(1, 6):
        chain += [(f"p{k}", 1000 + 10 * (k - 1), 0), *[(f"p{k}", 5000 + 10 * k + i, 1) for i in range(6)], (f"p{k}", 1000 + 10 * k, 0), (f"p{k}", 9000 + k, 0)]
    rows = [(c, i, s) for c, i, s in dict.fromkeys(edges + chain)]
    got = {r["context"] for r in trusted_patterns(spark.createDataFrame(rows, "context string, instance long, seed int")).collect()}
    trust = {i: 0.0 for _, i, _ in rows} | {i: 1.0 for _, i, s in rows if s}
    seeds, sizes = dict(trust), []
    for _ in range(300):
        by = {}
        for c, i, _ in rows:
            by.setdefault(c, []).append(trust[i])
        good = {c: sum(x) / len(x) for c, x in by.items() if sum(x) / len(x) >= 0.7 and sum(x) >= 5}
        trust = {i: max([seeds[i], *(good[c] for c, j, _ in rows if j == i and c in good)]) for i in trust}
        sizes.append(len(good))
    assert got == set(good) and sizes[1] < sizes[-1]
