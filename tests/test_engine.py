"""The engine's queries against their SQL, and its operators against values worked out by hand."""

import ast
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom import queries as Q
from fathom.functions import text as T
from fathom.functions.vectors import cosine
from fathom.operators import bm25, fusion, metrics
from fathom.operators.answers import generate, with_retries
from fathom.operators.chunkers import chunk_texts, split_chapters, split_lines, split_recursive
from fathom.operators.code import chunk_source, parses, split_code
from fathom.operators.filters import equals, matches, parse_filter
from fathom.operators.knn import nearest
from fathom.operators.paragraphs import paragraphs
from fathom.operators.embed import HashedTf
from fathom.operators.retrieve import Retriever, VectorIndex
from fathom.plans import reports
from fathom.sources import files, readers, writers
from fathom.sources.html import sections

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_matches_its_sql(spark, duck, name):
    out = Q.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)
    rel = duck.sql(Q.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == columns and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("fiancée Café", "fiance e cafe"), ("해리 포터", ""), ("A  b-C!", "a b c"), ("", "")])
def test_normalise(spark, text, want):
    assert T.normalise_text(text) == want == one(spark, T.normalise(F.col("t")), t=text)


@pytest.mark.parametrize(("needle", "held"), [("", False), ("!!", True), ("Big Dog", True), ("cat", False)])
def test_holds(spark, needle, held):
    assert one(spark, T.holds(F.col("h"), F.col("n")), h="a big, dog", n=needle) is held


def test_sentences_and_tails(spark):
    assert one(spark, T.sentences(F.col("t")), t="A. B! C?  D") == ["A.", "B!", "C?", "D"]
    assert one(spark, T.tail(F.col("t"), 3), t=" ab\n cd ") == " cd"
    assert one(spark, T.with_context(F.lit("before me"), F.col("t"), 64), t="x" * 96) == "x" * 96
    assert one(spark, T.with_context(F.lit("before me"), F.col("t"), 64), t="x") == "[CTX] before me\nx"


@pytest.mark.parametrize(("value", "full"), [(0.0, 0), (0.5 / 24, 0), (1.5 / 24, 2), (1.0, 24), (1.2, 24)])
def test_bar(spark, value, full):
    assert one(spark, T.bar(F.col("v")), v=value) == "█" * full + "░" * (24 - full)


def test_cosine_of_nothing(spark):
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def corpus(spark):
    return spark.createDataFrame([(0, "the cat"), (1, "the dog dog"), (2, "the cat"), (3, "the owl sat")], "doc_id long, text string")


def test_bm25_ranks_every_document(spark):
    index = bm25.build_index(corpus(spark))
    ask = lambda q, k=4: [(r["doc"], r["score"]) for r in bm25.top(index, spark.createDataFrame([(1, q)], "qid long, query string"), k).orderBy("rank").collect()]
    assert [d for d, _ in ask("zebra")] == [0, 1, 2, 3] and {s for _, s in ask("zebra")} == {0.0}
    once, twice = dict(ask("dog")), dict(ask("dog dog"))
    assert math.isclose(twice[1], 2 * once[1], abs_tol=1e-5)
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    raw = [math.log(4 - df + 0.5) - math.log(df + 0.5) for df in (4, 2, 1, 1, 1)]
    assert math.isclose(idf["the"], 0.25 * sum(raw) / 5)
    assert [d for d, _ in ask("owl", 2)] == [3, 0]


@pytest.mark.parametrize("asked", [0, 200_000])
@pytest.mark.parametrize("k", [1, 2, 6])
def test_bm25_of_negative_scores_and_many_terms(spark, monkeypatch, asked, k):
    monkeypatch.setattr(bm25, "ASKED", asked)
    texts = {0: "a b", 1: "a b a", 2: "a b", 3: "", 4: "a", 5: "a b c"}
    words = {d: t.split() for d, t in texts.items()}
    df = {w: sum(w in x for x in words.values()) for w in "abc"}
    raw = {w: math.log(6 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / 3 for w, x in raw.items()}
    assert idf["a"] < 0
    mean = sum(map(len, words.values())) / 6
    score = lambda q, x: sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in q.split() if w in idf)
    queries = {1: "a", 2: "a b b", 3: "c a", 4: "", 5: None}
    want = {(q, i + 1): d for q, t in queries.items() for i, d in enumerate(sorted(words, key=lambda d: (-round(score(t or "", words[d]), 6), d))[:k])}
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    found = bm25.top(index, spark.createDataFrame(list(queries.items()), "qid long, query string"), k).collect()
    assert {(r["qid"], r["rank"]): r["doc"] for r in found} == want


def test_fusions(spark):
    v = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 3)], "qid long, doc long, rank long")
    t = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "qid long, doc long, rank long")
    by = [(r["doc"], r["score"]) for r in fusion.fuse_by_position(v, t, 10).orderBy("rank").collect()]
    assert [d for d, _ in by] == [1, 0, 2, 3] and by[0][1] == round(2 / 61, 9) and by[1][1] == by[2][1]
    contents = spark.createDataFrame([(0, "cat"), (1, "dog"), (2, "cat"), (3, "owl")], "doc long, content string")
    top = fusion.fuse_by_content(v, t, contents).orderBy("rank").first()
    assert (top["content"], top["doc"], top["score"]) == ("cat", 2, round(2 / 61, 9))
    first = fusion.fuse_explained(v, t, contents).orderBy("rank").first()
    assert first["doc"] == 0 and math.isclose(first["vector_ratio"] + first["text_ratio"], 1, abs_tol=1e-6)


def test_nearest_breaks_ties_by_id_and_works_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "qid long, query_vec array<float>")
    monkeypatch.setattr("fathom.operators.knn.BLOCK_BYTES", 16)
    got = sorted((r["qid"], r["rank"], r["vec"]) for r in nearest(rows.repartition(3), asked, 2).collect())
    assert got == [(0, 1, 0), (0, 2, 3), (1, 1, 1), (1, 2, 4), (2, 1, 2), (2, 2, 5)]


def test_filters(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    count = lambda test: rows.where(test).count()
    assert count(equals({"k": "a", "n": 1}, rows.columns)) == 1 and count(equals({"n": None}, rows.columns)) == 1
    assert count(equals({"missing": None}, rows.columns)) == 2 and count(equals({"missing": 1}, rows.columns)) == 0
    assert count(matches({"k": ["a", "b"], "n": [None, 5]}, rows.columns)) == 1
    with pytest.warns(UserWarning):
        assert parse_filter("{bad") is None
    assert parse_filter('{"a": 1}') == {"a": 1} and parse_filter(None) is None


def test_retriever(spark):
    chunks = corpus(spark).withColumnRenamed("doc_id", "doc").withColumn("kind", F.when(F.col("doc") < 2, "x").otherwise("y"))
    asked = spark.createDataFrame([(1, "owl")], "qid long, query string")
    find = Retriever(chunks)
    assert [r["doc"] for r in find.retrieve(asked, 2, method="bm25").orderBy("rank").collect()] == [3, 0]
    assert [r["doc"] for r in find.retrieve(asked, 2, {"kind": "y"}).orderBy("rank").collect()][0] == 3
    assert find.retrieve_distinct(asked, 3).where("content is null").count() == 0
    with pytest.raises(ValueError):
        VectorIndex(chunks, "other", 3).check(HashedTf())


def test_ndcg_edges(spark):
    rows = [(1, i, r) for i, r in enumerate([0, 1, 0, 1, 0], 1)] + [(2, 1, 0)] + [(3, 1, 1), (3, 2, 1)]
    got = {r["qid"]: r for r in metrics.retrieval_by_query(spark.createDataFrame(rows, "qid long, rank int, relevant int"), 5).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert math.isclose(got[1]["ndcg"], want) and got[1]["reciprocal_rank"] == 0.5
    assert got[2]["ndcg"] == 0 and got[3]["ndcg"] == 1 and got[3]["hit_1"] == 1
    none = spark.createDataFrame([], "qid long, gold array<long>")
    assert metrics.retrieval_summary(metrics.retrieval_by_query(spark.createDataFrame([], "qid long, rank int, relevant int"), 5), none).first()["mrr"] == 0


def test_relevance_tiers(spark):
    def relevant(ids=(), symbols=(), sources=(), parent="class:A > function:prepare_url", strict=False):
        arrays = [F.array(*map(F.lit, x)).cast("array<string>") for x in (ids, symbols, sources)]
        return one(spark, metrics.is_relevant(F.lit("k"), F.lit("x/f.py"), F.lit(parent), F.lit("calls helper()"), *arrays, strict=strict))

    assert relevant(ids=["k"]) and not relevant(ids=["z"]) and relevant(ids=["z"], sources=["y/f.py"])
    assert relevant(symbols=["A.prepare"]) and not relevant(symbols=["A.prepare"], strict=True)
    assert relevant(symbols=["helper"]) and not relevant(symbols=["help"], sources=["f.py"])


def covers(text, chunks):
    """Whether the chunks hold all of a text that isn't white space, in order."""
    at = 0
    squeezed, plain = "".join(text.split()), ["".join(c.split()) for c in chunks]
    for c in plain:
        start = squeezed.rfind(c, 0, at + len(c))
        if start < 0:
            return False
        at = max(at, start + len(c))
    return at == len(squeezed) and all(plain)


def test_recursive_split_keeps_its_bounds():
    text = ("Para one is here.\n\nPara two has more words in it.\n" * 8) + "x" * 300
    for size, overlap in ((50, 10), (20, 0), (7, 3)):
        chunks = split_recursive(text, size, overlap)
        assert all(0 < len(c) <= size for c in chunks) and covers(text, chunks)
    with pytest.raises(ValueError):
        split_recursive("x", 5, 6)


def test_line_packing():
    assert split_lines("aaaa\nbbbb\ncc\n\n", 10, 0) == ["aaaa\nbbbb", "cc\n"]
    assert split_lines("aaaa\nbbbb\ncccc", 10, 2) == ["aaaa\nbbbb", "bb\ncccc"]
    assert split_lines("long" * 9 + "\nx", 10, 0) == ["long" * 9, "x"] and split_lines("\n\n", 10, 2) == []


def test_chapters():
    got = split_chapters("preamble\nCHAPTER ONE start\nfirst para\n\nsecond para\n\nChapter 2\nthird\n", 64, 0)
    assert [(r["chapter_title"], r["text"]) for r in got] == [("CHAPTER ONE start", "first para"), ("CHAPTER ONE start", "[CTX] first para\nsecond para"), ("Chapter 2", "third")]
    assert [r["chapter_title"] for r in split_chapters("CHAPTER 1\nx", 256, 0)] == ["unknown"]
    long = split_chapters("word " * 100, 64, 0)
    assert [r["boundary_truncated"] for r in long] == [True] * (len(long) - 1) + [False] and all(r["split_from_long_paragraph"] for r in long)
    assert not any(r["context_augmented"] for r in split_chapters("a\n\nb", 256, 0))


@pytest.mark.parametrize(("n", "want"), [(0, 0), (4, 1), (5, 1), (6, 2), (9, 3)])
def test_token_windows(spark, n, want):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "doc_id long, text string")
    chunks = [r["text"] for r in chunk_texts(docs, "token", 5, 3).orderBy("pos").collect()]
    assert len(chunks) == want and chunks == [r["text"] for r in chunk_source(" ".join(map(str, range(n))), "token", 5, 3)]


CODE = '''import os
x = 1

class A(Base):
    """doc"""
    y = 2

    @property
    def p(self):
        def inner():
            return 1
        return inner()

if x:
    def late():
        return 5

def f():
    pass

z = 3
'''


def test_code_chunks():
    got = split_code(CODE)
    names = [(c["node_type"], c["parent"]) for c in got]
    assert ("FunctionDef", "class:A > function:p") in names and not any("inner" in c["parent"] for c in got)
    assert [c["text"].splitlines()[0] for c in got if c["node_type"] == "orphan"] == ["import os", "if x:", "z = 3"]
    method = next(c for c in got if c["parent"].endswith("function:p"))
    assert method["text"].startswith('"""doc"""') and "@property" not in method["text"]
    assert split_code("def broken(:") == []
    small = chunk_source(CODE, "structure_code", 40, 0)
    assert any("_" in c["chunk_id"] and c["fallback_chunked"] for c in small) and all(len(c["text"]) <= 40 for c in small)


def test_integrity_of_chunks_is_that_of_plain_python(spark):
    """The one engine query that SQL can't say, since it parses Python."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {}
    for _, text in docs:
        body = "class A:\n    x = 1\n    def f(self):\n        return '''" + text.replace("'", "") + "'''\n\ny = 2\n"
        for c in chunk_source(body, "structure_code", 500, 50):
            first = next((x for x in c["text"].split("\n") if x.strip()), "")
            orphan = c.get("is_orphan")
            orphan = first[:1] in " \t" and first != "" and not first.lstrip().startswith(("def ", "class ", "@", '"""', "'''", "#")) if orphan is None else orphan
            row = want.setdefault(c["node_type"], [0, 0, 0])
            row[0] += 1
            row[1] += not parses(c["text"])
            row[2] += orphan
    got = {r["node_type"]: [r["total"], r["syntax_error_count"], r["orphan_count"]] for r in Q.integrity_report(spark, SF).collect()}
    assert got == want and want["FunctionDef"][1] > 0


@pytest.mark.parametrize(("code", "fine"), [("return x", True), ("  a = 1\n  b = 2", True), ("def f(:", False), ("", True)])
def test_parses(code, fine):
    assert parses(code) is fine


def test_paragraph_numbering(spark):
    text = "before\nmore\r\n\r\nPage | 12\nCHAPTER ONE\nfirst\n\nTHE END OF IT\nlast  \n"
    rows = paragraphs(spark.createDataFrame([("Book3.txt", text), ("Other.txt", "x\n\ny")], "source_file string, text string")).collect()
    got = {r["paragraph_id"]: r["text"] for r in rows}
    assert got == {"book_3_chapter_1_paragraph_1": "before\nmore", "book_3_chapter_1_paragraph_2": "first", "book_3_chapter_2_paragraph_1": "last", "other_chapter_1_paragraph_1": "x", "other_chapter_1_paragraph_2": "y"}


def test_html_sections(spark):
    page = "<h3>One</h3><p>first <b>bold</b></p><script>'</p><h3>no</h3>'</script><p>second</p><h2>stop</h2><p>not this</p><h3>X</h3><p>short name</p><h3>Empty</h3>"
    assert [(r["name"], r["description"]) for r in sections(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()] == [("One", "first bold second")]


def test_generation_records_failures(spark):
    class Model:
        model_id = "test"

        def __call__(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("no")
            return prompt.upper()

    rows = {r["qid"]: r for r in generate(spark.createDataFrame([(1, "a b"), (2, "bad")], "qid long, prompt string"), Model).collect()}
    assert rows[1]["response"] == "A B" and rows[1]["response_token_count"] == 2 and rows[2]["response"] is None and "RuntimeError" in rows[2]["error"]
    waits = []

    def fail(_):
        raise OSError

    assert with_retries(fail, 3, 4.0, waits.append)("x") == "" and waits == [4.0, 8.0]


class Counting:
    """A generator that says which one it is."""

    model_id = "counting"
    made = 0

    def __init__(self):
        type(self).made += 1
        self.number = type(self).made

    def __call__(self, prompt):
        import os

        return f"{os.getpid()}:{self.number}"


def test_a_worker_makes_its_generator_once(spark):
    rows = spark.range(64).selectExpr("id AS qid", "'x' AS prompt").repartition(16)
    said = [r["response"] for r in generate(rows, Counting).collect()] + [r["response"] for r in generate(rows, Counting).collect()]
    assert len({x.split(":")[0] for x in said}) == len(set(said))


def test_writes_side_by_side_leave_the_session_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from fathom.runtime import CLEANUP, materialize

    before = spark.conf.get(CLEANUP)
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda n: materialize(spark.range(n * 100).repartition(3), "side").count(), range(1, 7)))
    assert made == [n * 100 for n in range(1, 7)] and spark.conf.get(CLEANUP) == before
    rows = spark.range(1000).repartition(5)
    assert sum(1 for _ in rows.toLocalIterator()) == 1000


def test_work_tables_go_with_their_scope(spark):
    from fathom.runtime import materialize, work_scope

    kept = materialize(spark.range(3), "kept")
    with work_scope() as keep:
        also = keep(materialize(spark.range(6), "also"))
        outer = materialize(spark.range(4), "outer")
        with work_scope():
            inner = materialize(spark.range(5), "inner")
            assert inner.count() == 5
        assert not files.exists(spark, inner.work_path) and outer.count() == 4
    assert not files.exists(spark, outer.work_path) and kept.count() == 3 and also.count() == 6


def test_readers_and_writers(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.TXT").write_text("two\nlines")
    (folder / "sub" / "a.txt").write_text("one")
    (folder / "c.py").write_text("x = 1")
    assert [r["source_file"] for r in readers.text_files(spark, str(folder), (".txt",)).collect()] == ["b.TXT", "a.txt"]
    assert readers.text_files(spark, str(folder), (".txt",), recursive=False).count() == 1
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"qid": "1", "gold_sources": ["a"]}\n\n{"qid": "2"}\n')
    assert readers.json_lines(spark, str(lines)).count() == 2
    lines.write_text('{"qid": "1"}\n\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_lines(spark, str(lines)).collect()
    assert [r["_error"] for r in readers.json_lines_with_errors(spark, str(lines)).collect()] == [None, "line 3: {broken"]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    writers.write_json_array(rows, str(tmp_path / "arr"))
    assert sorted(r["n"] for r in json.loads("".join(p.read_text() for p in (tmp_path / "arr").glob("part-*")))) == [1, 2]
    writers.write_csv(rows, str(tmp_path / "csv"), ["s", "n"])
    assert readers.csv_table(spark, str(tmp_path / "csv")).columns == ["s", "n"]
    assert [r["text"] for r in writers.equal_slices(spark.createDataFrame([("abcdefghij",)], "text string"), 3).orderBy("slice").collect()] == ["abc", "def", "ghij"]
    assert writers.grouped_files(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k int, text string"), "k", "text").count() == 3
    assert writers.boxed("ab\nc").splitlines()[1] == "| ab |"
    assert files.first_existing(spark, [str(tmp_path / "no"), str(folder)]) == str(folder) and files.first_existing(spark, ["/no"], default_first=False) is None
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "path string")
    found = files.discover_settings(names("a/chunks_fixed_256.json", "a/chunks_token_64.json"), names("i/index_fixed_256.faiss"))
    assert [r["setting"] for r in found.collect()] == ["fixed_256"]


def test_reports(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "setting string, mrr double")
    assert reports.markdown(rows, ["setting"]).splitlines()[2:] == ["| a | 0.5000 |", "| b | 0.2500 |"]
    assert [r["line"] for r in reports.aligned(rows, ["setting"]).collect()] == ["a        0.5 ", "b        0.25"]


def test_stream_of_files(spark, tmp_path):
    from fathom.streaming.ingest import stream_chunks

    corpus(spark).write.parquet(str(tmp_path / "in"))
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), size=2, overlap=0).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_explained", "hit_mrr_ndcg_sparse", "merge_metrics"])
def test_plans_hold_no_row_at_a_time_python(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_nothing_outside_imports_the_corpus_operators():
    import pathlib

    for p in pathlib.Path(Q.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("fathom.llm") for n in names), p


def test_html_sections_of_the_query_want_ended_references(spark, tmp_path):
    """A title that was cut inside a reference stays as it is in the query, as its SQL has it; the reader decodes it."""
    from fathom import queries as Q

    page = "<h1>cats &amp; dogs &amp</h1><p>x &lt y &copy; &amp;lt; &am</p>"
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in Q.html_sections(spark, str(tmp_path)).collect()] == [(1, 0, "cats & dogs &amp", "x &lt y © &lt; &am")]
    read = sections(spark.read.parquet(f"{tmp_path}/pages.parquet"), name="h1", ends=("h1", "h2", "h3")).collect()
    assert [r["name"] for r in read] == ["cats & dogs &"]


def test_chunks_are_handed_on_in_small_batches():
    """However many texts come at once, and however many chunks they make, a worker gathers few of them."""
    import pyarrow as pa

    from fathom.operators.chunkers import OUT_CHARS, OUT_ROWS, handed_on

    texts = ["ab" * 500, None, "", "c" * (OUT_CHARS // 2)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(texts)], names=["id", "text"])
    split = lambda t: [{"pos": n, "text": c} for n, c in enumerate([t[: OUT_CHARS // 2]] if len(t or "") > 2000 else t or "")]
    made = list(handed_on(iter([batch]), split, "id", {"pos": pa.int32(), "text": pa.string()}))
    assert max(b.num_rows for b in made) <= OUT_ROWS
    assert max(sum(map(len, b["text"].to_pylist())) for b in made) < OUT_CHARS + OUT_CHARS // 2
    rows = [(i, r["pos"], r["text"]) for i, t in enumerate(texts) for r in split(t)]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == rows
