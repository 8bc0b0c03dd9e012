"""Names that clash, ids of other types, nulls, repeats, empty tables and very long texts, for every operator."""

import pytest
from pyspark.sql import functions as F

from fathom.llm.decontaminate import mark_contamination, remove_contamination
from fathom.llm.jaccard import jaccard_components, keep_one_of_each
from fathom.llm.licenses import license_reports
from fathom.llm.line_dedup import drop_frequent_lines
from fathom.llm.mixing import draw_mix, mix_sources
from fathom.llm.pii import pii_digests
from fathom.llm.quality import judge_quality, keep_good
from fathom.llm.queries import vocabulary
from fathom.llm.secrets import scan_secrets, secret_digests
from fathom.llm.suffix_dedup import string_digests
from fathom.llm.token_files import token_digests, write_token_files

PROSE = " ".join(f"the {w} of it went on and came back again to rest." for w in ("river", "house", "garden", "letter", "winter", "summer", "stone", "road"))
TEXTS = [PROSE, PROSE, "one two three four five six seven eight nine ten", None, "", "a\nb\n" + PROSE, "user = someone password = hunter22 a@b.cd", "w " * 30_000 + "x", "Licensed under the MIT License."]
CLASH = ["N_LINES", "n_dropped", "Size", "__p", "copies", "SECRETS", "__spans", "SPANS", "__words", "n_words", "__id", "__row", "row", "id", "hash", "plan", "found", "a.b"]


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")


def tokens(docs):
    return token_digests(docs.sparkSession, write_token_files(docs, vocabulary())[0])


OPERATORS = {
    "lines": drop_frequent_lines,
    "licenses": license_reports,
    "quality": judge_quality,
    "good": keep_good,
    "tokens": tokens,
    "links": jaccard_components,
    "firsts": keep_one_of_each,
    "strings": string_digests,
    "mix": mix_sources,
    "drawn": draw_mix,
    "marked": lambda d: mark_contamination(d, items(d.sparkSession)),
    "marked in blocks": lambda d: mark_contamination(d, items(d.sparkSession).union(items(d.sparkSession)), block_words=12),
    "cut": lambda d: remove_contamination(d, items(d.sparkSession)),
    "secrets": scan_secrets,
    "secret figures": secret_digests,
    "pii": pii_digests,
}
#: Those whose files, or whose order, need integers.
INTEGERS = {"tokens", "links", "firsts", "strings"}
#: Those that give back the columns of their input, and those that give every row again.
SAME, EVERY = {"good", "firsts", "drawn", "cut"}, set(OPERATORS) - {"good", "firsts", "drawn", "cut"}


def table(spark, kind="long"):
    rows = [(None if i == 5 else i, t, "s" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(0, PROSE, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = OPERATORS[name](table(spark))
    wide = table(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    full = OPERATORS[name](wide)
    assert len({c.lower() for c in full.columns}) == len(full.columns)
    if name in SAME:
        assert full.columns == wide.columns
    key = lambda r: tuple(map(str, r))
    common = [f"`{c}`" for c in plain.columns]
    got = sorted(map(tuple, full.select(*common).collect()), key=key)
    want = sorted(map(tuple, plain.collect()), key=key)
    assert got == want
    assert len(want) == len(TEXTS) + 1 or name not in EVERY


@pytest.mark.parametrize("name", OPERATORS)
def test_other_ids(spark, name):
    run = OPERATORS[name]
    if name in INTEGERS:
        with pytest.raises(TypeError, match="doc_id must be an integer"):
            run(table(spark, "string"))
        assert run(table(spark, "int")).count() == run(table(spark)).count()
    else:
        assert run(table(spark, "string")).count() == run(table(spark)).count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = table(spark).where("false")
    out = OPERATORS[name](empty)
    assert out.count() == 0 and (name not in SAME or out.columns == empty.columns)


def test_lines_of_a_long_text(spark):
    """Ten documents of 20,000 lines, half of them shared: places come back in one pass."""
    text = "\n".join(f"line {i // 2 * 2}" if i % 2 else f"own {i} %d" for i in range(20_000))
    docs = spark.createDataFrame([(n, (text % ((n,) * 10_000)) if n < 10 else "x") for n in range(11)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"].count("\n")) for r in drop_frequent_lines(docs).collect()}
    assert got == {n: (20_000, 10_000, 9_999) if n < 10 else (1, 0, 0) for n in range(11)}


def test_spans_of_a_long_text(spark):
    """20,000 places in one text, of two kinds that meet at every step."""
    secrets = " ".join(f"login=user{i} Zk3{i:05d}aB9xQaB9xQaB9xQ" for i in range(10_000))
    mails = " ".join(f"mail p{i}@example.com no AB-{i:05d}" for i in range(10_000))
    docs = spark.createDataFrame([(1, secrets), (2, mails)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_assign"], r["spans"].count("identity"), r["spans"].count("random"), r["links"].count(">")) for r in secret_digests(docs).collect()}
    assert found[1] == (0, 10_000, 10_000, 20_000)
    assert {r["doc_id"]: r["n_email"] for r in pii_digests(docs).collect()}[2] == 10_000


def test_an_item_longer_than_a_block(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words[17:44])), (2, " ".join(words[:5] + words[50:59]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    for block in (12, 30, 1_000):
        got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["hit_items"]) for r in mark_contamination(docs, bench, block_words=block).collect()}
        assert got == {1: ([(0, 27)], ["7"]), 2: ([], [])}, block
