"""The text index, embedders, inverted lists, resumable runs and the command line, against plain versions."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import cli
from fathom.operators import bm25, ivf, similar
from fathom.operators.embed import HashedTf, TfIdf
from fathom.operators.knn import nearest
from fathom.operators.retrieve import Retriever, build_vector_index, open_vector_index, save_vector_index
from fathom.plans.ledger import Ledger
from fathom.sources import readers
from fathom.streaming.ingest import stream_index, streamed_index


def ranks(docs, queries, k):
    """{query: [(doc, score)]}, all documents ranked, by brute force over [(doc, text)]."""
    words = [(d, (t or "").split()) for d, t in docs]
    n, df = len(words), Counter(w for _, ws in words for w in set(ws))
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    avgdl = sum(len(ws) for _, ws in words) / max(1, n)
    out = {}
    for q, text in queries:
        asked = Counter((text or "").split())
        scored = []
        for d, ws in words:
            tf = Counter(ws)
            scored.append((d, round(sum(m * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w, m in asked.items() if w in tf), 6)))
        out[q] = sorted(scored, key=lambda x: (-x[1], x[0]))[:k]
    return out


def some_docs(n=300, seed=1):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.6)) % 90}" for _ in range(400)]
    texts = [" ".join(pick.choices(vocabulary, k=pick.randrange(0, 30))) for _ in range(n)]
    return [(i, None if i == 7 else texts[i % (n - 40)]) for i in range(n)]


QUERIES = [(1, "w1 w2 w3"), (2, "w40 w41 w1 w1"), (3, "absent"), (4, ""), (5, None), (6, "w1"), (7, " ".join(f"w{i}" for i in range(60)))]


def asked(spark):
    return spark.createDataFrame(QUERIES, "qid long, query string")


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def found(ranked, group=None):
    out = {q: [] for q, _ in QUERIES}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        if group is None or r["grp"] == group:
            out[r["qid"]].append((r["doc"], pytest.approx(r["score"], abs=2e-6)))
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("size", [512, 16])
def test_every_document_is_ranked(spark, monkeypatch, k, size):
    monkeypatch.setattr(bm25, "SEGMENT_DOCS", size)
    monkeypatch.setattr(bm25, "ASKED", 4 if size == 16 else 200_000)  # queries in blocks
    docs = some_docs()
    assert found(bm25.top(bm25.build_index(table(spark, docs)), asked(spark), k)) == ranks(docs, QUERIES, k)


def test_scores_of_all_that_hold_a_term(spark):
    docs = some_docs(80)
    want = {(q, d): s for q, rows in ranks(docs, QUERIES, 80).items() for d, s in rows if set((dict(docs)[d] or "").split()) & set((dict(QUERIES)[q] or "").split())}
    got = {(r["qid"], r["doc"]): r["score"] for r in bm25.scores(bm25.build_index(table(spark, docs)), asked(spark)).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) > 100


def test_bounds_hold_and_spare_work(spark):
    index = bm25.build_index(table(spark, some_docs()))
    (_, asked_for), *_ = bm25._blocks(index, asked(spark), "qid", "query")
    for r in index.segments.toArrow().to_batches():
        for _, _, segment in bm25._opened(iter([r]), asked_for):
            bounds = segment.bounds(len(QUERIES))
            for q in range(len(QUERIES)):
                assert segment.scores(q)[0].max() <= bounds[q] + 1e-6


def test_groups_have_statistics_of_their_own(spark):
    docs = some_docs()
    rows = table(spark, docs).withColumn("part", (F.col("doc_id") % 3).cast("string"))
    ranked = bm25.top(bm25.build_index(rows, by="part"), asked(spark), 4).cache()
    for g in "012":
        assert found(ranked, g) == ranks([x for x in docs if x[0] % 3 == int(g)], QUERIES, 4)


def test_an_index_grows_and_shrinks(spark, tmp_path):
    docs = some_docs()
    index = bm25.build_index(table(spark, docs[:100]))
    index = bm25.extend_index(index, table(spark, docs[100:]))
    gone = {d for d, _ in docs if d % 7 == 3}
    index = bm25.remove_documents(index, spark.createDataFrame([(d,) for d in gone] + [(10**6,)], "doc long"))
    bm25.save_index(index, str(tmp_path))
    left = [x for x in docs if x[0] not in gone]
    assert found(bm25.top(bm25.open_index(spark, str(tmp_path)), asked(spark), 5)) == ranks(left, QUERIES, 5)
    df = {r["term"]: r["df"] for r in index.terms.collect()}
    assert df == Counter(w for _, t in left for w in set((t or "").split()))


def test_an_index_follows_a_stream(spark, tmp_path):
    docs, schema = some_docs(), "doc_id long, text string, deleted boolean"

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/all/{n}")
        (part,) = (tmp_path / "all" / str(n)).glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{n}.parquet")

    def run():
        stream_index(spark, f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/state", schema, files=1).awaitTermination(120)
        return found(bm25.top(streamed_index(spark, f"{tmp_path}/index"), asked(spark), 5))

    arrive(0, [(d, t, False) for d, t in docs[:200]])
    assert run() == ranks(docs[:200], QUERIES, 5)
    arrive(1, [(d, t, None) for d, t in docs[200:]] + [(5, None, True), (6, None, True), (6, "w40 w41 w42", False)])
    now = dict(docs) | {6: "w40 w41 w42"}
    del now[5]
    assert run() == ranks(sorted(now.items()), QUERIES, 5)


def test_ids_of_other_types(spark):
    docs = some_docs(60)
    for kind in ("string", "struct"):
        doc = F.lpad(F.col("doc_id").cast("string"), 4, "0") if kind == "string" else F.struct("doc_id", F.lit(1).alias("pos"))
        ranked = bm25.top(bm25.build_index(table(spark, docs).withColumn("doc_id", doc)), asked(spark), 3)
        got = {(r["qid"], r["rank"]): int(r["doc"] if kind == "string" else r["doc"]["doc_id"]) for r in ranked.collect()}
        assert got == {(q, i + 1): d for q, rows in ranks(docs, QUERIES, 3).items() for i, (d, _) in enumerate(rows)}


def test_an_empty_corpus_and_no_queries(spark):
    none = bm25.build_index(table(spark, some_docs(50)).where("false"))
    assert bm25.top(none, asked(spark), 3).count() == 0
    assert bm25.top(bm25.build_index(table(spark, some_docs(50))), asked(spark).where("false"), 3).count() == 0


# ---- embedders


def test_weights_are_those_of_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "A c"), (3, None), (4, "")], "doc long, text string")
    fit = TfIdf.fit(docs, dim=64)
    import hashlib

    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64
    assert len({bucket(t) for t in "abc"}) == 3 and fit.documents == 4
    assert fit.idf[bucket("a")] == pytest.approx(math.log(5 / 3)) and fit.idf[bucket("b")] == pytest.approx(math.log(5 / 2))
    v = {r["doc"]: r["v"] for r in fit.embed(docs, "text", "v").collect()}
    weights = {"a": math.log(5 / 3), "b": 2 * math.log(5 / 2)}
    size = math.sqrt(sum(x * x for x in weights.values()))
    assert v[1][bucket("b")] == pytest.approx(weights["b"] / size, abs=1e-6) and sum(v[3]) == sum(v[4]) == 0
    index = build_vector_index(docs, fit)
    save_vector_index(index, fit, str(tmp_path))
    opened, again = open_vector_index(spark, str(tmp_path))
    opened.check(again)
    assert again.name == fit.name and opened.vectors.count() == 4
    other = TfIdf.fit(docs.where("doc = 1"), dim=64)
    for embedder in (other, HashedTf(64)):
        with pytest.raises(ValueError, match="the index is of"):
            opened.check(embedder)


def test_rare_words_count_for_more(spark):
    texts = ["common common rare", "common common common", *["common words here"] * 30, "rare thing"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    find = Retriever(chunks)
    best = [r["doc"] for r in find.retrieve(spark.createDataFrame([(1, "common rare")], "qid long, query string"), 2, method="vector").orderBy("rank").collect()]
    assert set(best) == {0, 32} and find.embedder.documents == 33


# ---- inverted lists


def clustered(n=2000, seed=5):
    pick = np.random.default_rng(seed)
    return (pick.normal(size=(20, 16))[pick.integers(0, 20, n)] + 0.15 * pick.normal(size=(n, 16))).astype("float32")


def test_lists_cover_every_row_and_find_the_nearest(spark):
    x = clustered()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    index = ivf.build_lists(vectors.where("vec_id < 1500"), 24, sample=600)
    ivf.add_vectors(index, vectors.where("vec_id >= 1500"))
    index = ivf.open_lists(spark, index.folder)
    held = index.vectors(spark)
    assert sorted(r["vec"] for r in held.select("vec").collect()) == list(range(2000))
    as_set = lambda df: {(r["qid"], r["rank"], r["vec"]) for r in df.collect()}
    assert as_set(ivf.search_lists(index, queries, 10, probes=24)) == as_set(nearest(vectors, queries, 10))
    few = ivf.recall(index, vectors, queries, 10, probes=4).first()
    assert few["queries"] == 40 and few["recall"] >= 0.9
    one = queries.where("qid = 50")
    found_in = ivf.search_lists(index, one, 5, probes=2)
    plan = found_in._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and " IN (" in plan  # files of other lists aren't read


def test_lists_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert len(ivf.fit_centroids(none, 4)) == 0
    index = ivf.build_lists(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>"), 4)
    asked_for = spark.createDataFrame([(9, [0.0])], "qid long, query_vec array<float>")
    assert [(r["vec"], r["distance"]) for r in ivf.search_lists(index, asked_for, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert ivf.search_lists(index, asked_for.where("false"), 3).count() == 0


# ---- sentences and their contexts


@pytest.mark.parametrize("block", [64 << 20, 900])
@pytest.mark.parametrize("own", [True, False])
def test_most_similar_is_the_best_of_all_pairs(spark, monkeypatch, block, own):
    monkeypatch.setattr(similar, "BLOCK_BYTES", block)
    pick = np.random.default_rng(3)
    v = lambda: pick.normal(size=40).round(3)
    sentences = [(f"q{i % 4}", i, v()) for i in range(30)] + [("alone", 100, v()), ("q1", 101, np.zeros(40))]
    contexts = [(f"q{pick.integers(0, 4)}", int(pick.integers(0, 30)), v()) for _ in range(400)] + [("q0", i, x) for _, i, x in sentences[:12:4]] + [("other", 5, v()), ("q2", 3, np.zeros(40))]
    frame = lambda rows: spark.createDataFrame([(q, s, x.tolist()) for q, s, x in rows], "qid string, sid long, v array<double>").repartition(4)
    got = {(r["qid"], r["sid"]): r["best"] for r in similar.most_similar(frame(sentences), frame(contexts) if own else frame(contexts).drop("sid")).collect()}

    def likeness(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / size) if size else 0.0

    for q, s, x in sentences:
        all_ = [likeness(x, y) for p, t, y in contexts if p == q and not (own and s == t)]
        assert got.pop((q, s)) == (pytest.approx(max(all_), abs=1e-9) if all_ else None)
    assert not got


# ---- runs that go on


def test_a_stopped_run_goes_on(spark, tmp_path):
    ledger, calls = Ledger(spark, str(tmp_path)), []

    def work(name, stop=()):
        calls.append(name)
        if name in stop:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(len(name),)], "n int")

    names = ["a/1", "b=2", "c 3%"]
    with pytest.raises(RuntimeError):
        ledger.run(names, lambda n: work(n, stop={"b=2"}))
    assert ledger.done() == {"a/1"}
    assert Ledger(spark, str(tmp_path)).run(names, work) == ["b=2", "c 3%"] and calls == ["a/1", "b=2", "b=2", "c 3%"]
    assert ledger.run(names, work) == []
    rows = ledger.results("n int").collect()
    assert len(rows) == 3 and {r["n"] for r in rows} == {3, 4}
    assert ledger.commit("a/1", spark.createDataFrame([(99,)], "n int")) is False  # the first attempt stays
    assert {r["n"] for r in ledger.results("n int").collect()} == {3, 4} and not list((tmp_path / "attempts").glob("*/part*"))
    ledger.forget("a/1")
    assert ledger.done() == {"b=2", "c 3%"} and ledger.run(names, work) == ["a/1"]
    assert Ledger(spark, f"{tmp_path}/other").results("n int").count() == 0


# ---- lines with numbers, and the command line


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    lines = [("" if i % 11 == 5 else "{bad" if i % 97 == 3 else json.dumps({"qid": str(i)})) for i in range(20_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("{bad\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.json_lines_with_errors(spark, str(tmp_path), "qid string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"line {i + 1}: {{bad" for i, x in enumerate(lines) if x == "{bad"] + ["line 1: {bad"]
    assert sorted(r["_error"] for r in rows if r["_error"]) == sorted(want)
    assert len(rows) == sum(x != "" for x in lines) + 1
    assert readers.json_lines_with_errors(spark, f"{tmp_path}/none.jsonl", "qid string").collect() == []


def test_questions_from_the_command_line(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([(1, "Owls fly at night. They hunt.", "a.txt", "book"), (2, "Cats sleep all day.", "b.txt", "review"), (3, "Owls sleep too.", "b.txt", "review")], "chunk_id long, text string, source_file string, source string")
    chunks.write.parquet(f"{tmp_path}/chunks")
    asked_for = tmp_path / "q.jsonl"
    asked_for.write_text('{"query": "Owls too."}\n\n{"query": "Owls", "filter": {"source": "review"}}\n{"query": " "}\n')
    assert cli.main(["--chunks", f"{tmp_path}/chunks", "--queries", str(asked_for), "--method", "bm25", "--k", "1"]) == 1
    shown = capsys.readouterr().out
    first, second, third = shown.split("== ")[1:]
    assert "[1] b.txt: Owls sleep too." in first and "[1] b.txt: Owls sleep too." in second and "error: ValueError: no question" in third
    with pytest.warns(UserWarning, match="not a JSON object"):
        assert cli.main(["--chunks", f"{tmp_path}/chunks", "--query", "night owls", "--filter", "{bad"]) == 0
    shown = capsys.readouterr().out
    assert "Owls fly at night. They hunt." in shown and "sources: " in shown


def test_a_filter_of_the_wrong_type_fails_alone(spark):
    chunks = spark.createDataFrame([(1, "owls", 1), (2, "cats", 2)], "doc long, text string, volume int")
    rows = cli.search_batch(chunks, [("owls", '{"volume": {"x": 1}}'), ("owls", '{"volume": 1}')], k=1, method="bm25").collect()
    got = {r["qid"]: (r["doc"], r["error"]) for r in rows}
    assert got[1] == (1, None) and got[0][0] is None and got[0][1]


def test_row_groups_of_segments_are_small(spark):
    """A row group is read at once, so it holds few segments, however many a file has."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("w1 w2").alias("text"), (F.col("id") % 50).alias("lang"))
    index = bm25.build_index(docs, by="lang")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(index.segments.work_path.removeprefix("file://") + "/*.parquet")]
    assert max(f.num_rows for f in files) > 8
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 8


@pytest.mark.parametrize("by", [None, "part"])
def test_workers_get_small_batches(spark, monkeypatch, by):
    """A worker gets a bounded number of bytes at once, to make segments and to search them, however large
    its part of the table is; the ranking stays what it is, and so does the session."""
    from fathom import runtime

    def one_by_one(batches, asked, opened=bm25._opened):
        for batch in batches:
            assert batch.num_rows == 1
            yield from opened(iter([batch]), asked)

    docs = some_docs()
    rows = table(spark, docs).withColumn("part", (F.col("doc_id") % 3).cast("string"))
    before = spark.conf.get(runtime.ARROW_BYTES)
    wanted = sorted(bm25.top(bm25.build_index(rows, by=by), asked(spark), 4).collect())
    monkeypatch.setattr(runtime, "BATCH_BYTES", 512)
    index = bm25.build_index(rows, by=by)
    monkeypatch.setattr(runtime, "BATCH_BYTES", 1)
    monkeypatch.setattr(bm25, "_opened", one_by_one)
    assert index.segments.agg(F.max("n")).first()[0] < 16
    assert sorted(bm25.top(index, asked(spark), 4).collect()) == wanted
    assert spark.conf.get(runtime.ARROW_BYTES) == before


@pytest.mark.parametrize("by", [None, "part"])
def test_statistics_start_no_other_workers(spark, by):
    """Sizes of groups reach the tasks without Python: a table of Python rows would have workers of its own
    beside those of the index. An empty corpus has none."""
    rows = table(spark, some_docs()).withColumn("part", (F.col("doc_id") % 3).cast("string"))
    for corpus in (rows, rows.limit(0)):
        index = bm25.build_index(corpus, by=by)
        for made in (index.totals, index.terms):
            assert "ExistingRDD" not in made._jdf.queryExecution().toString()
        assert index.totals.count() == (corpus.select(by).distinct().count() if by else min(1, corpus.count()))
        assert index.terms.count() == index.counts.count()


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    """Arrow keeps what it frees, and a worker outlives its task: making and searching segments give it back."""
    import pyarrow as pa

    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    rows = pa.RecordBatch.from_pydict({"grp": ["a", "a"], "doc": [1, 2], "words": [["x", "y"], ["y"]]})
    made = list(bm25._segment(iter([rows] * 3)))
    assert len(made) == len(given) == 3
    assert len(list(bm25._opened(iter(made), {"a": bm25._Asked(1.5, [[("y", 1.0)]])}))) == 3
    assert len(given) == 6


def test_nearest_holds_few_differences(spark, monkeypatch):
    """A worker's differences of queries and vectors take a few MB, however many vectors a batch has."""
    import tracemalloc

    import pyarrow as pa

    found, vectors = [], spark.range(1).selectExpr("id AS vec_id", "array_repeat(CAST(id AS FLOAT), 64) AS embedding")
    asked = spark.range(200).selectExpr("id AS qid", "array_repeat(CAST(id AS FLOAT), 64) AS query_vec")
    whole = type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, run, *a: found.append(run) or whole(self, run, *a))
    nearest(vectors, asked, 3)
    batch = pa.RecordBatch.from_pydict({"vec": range(2000), "e": pa.array([[float(i)] * 64 for i in range(2000)], pa.list_(pa.float32()))})
    tracemalloc.start()
    (made,) = found[0](iter([batch]))
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()
    assert made.column(1).to_pylist()[:3] == [0, 1, 2] and made.column(2).to_pylist()[:3] == [0.0, 64.0, 256.0]


def test_thinning_takes_segments_one_at_a_time():
    """Segments that come in one batch leave one by one, as arrays; an emptied one doesn't leave."""
    import pyarrow as pa

    rows = [("a", None, ["x", "y", "y"]), ("b", None, []), ("c", None, ["y"])]
    flat = pa.RecordBatch.from_arrays([pa.nulls(3, pa.string()), pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["grp", "doc", "words"])
    (one,) = bm25._segment(iter([flat]))
    three = pa.Table.from_batches([one] * 3).combine_chunks().append_column("gone", pa.array([[0], [2], [0, 1, 2]], pa.list_(pa.int32()))).to_batches()[0]
    made = [b.to_pylist() for b in bm25._thin(iter([three]))]
    assert [len(b) for b in made] == [1, 1]
    held = [{k: v for k, v in b[0].items() if k not in ("seg", "grp")} for b in made]
    assert held[0] == {"n": 2, "words": 1, "docs": ["b", "c"], "dls": [0, 1], "terms": ["y"], "dfs": [1], "ats": [1], "tfs": [1]}
    assert held[1] == {"n": 2, "words": 3, "docs": ["a", "b"], "dls": [3, 0], "terms": ["x", "y"], "dfs": [1, 1], "ats": [0, 0], "tfs": [1, 2]}


def test_streamed_files_grow_in_number(spark, tmp_path):
    """More text makes more files, not larger ones; they still come in three batches."""
    from fathom import queries as Q
    from fathom.runtime import parts

    docs = spark.range(1000).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 512) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = Q.table(spark, str(tmp_path), "documents")
    assert parts(read) == 1 and parts(read, 4096) > 10


def test_buckets_of_tokens_are_their_md5s():
    """Tokens are hashed by distinct value, in lists with empty and null ones and in a slice of them."""
    import hashlib

    import pyarrow as pa

    from fathom.operators.embed import _buckets

    lists = [["a", "é", "a"], [], None, ["한", "a"], ["z"]]
    words = pa.array([["left out"], *lists], pa.list_(pa.string())).slice(1)
    rows, b = _buckets(words, 97)
    assert list(zip(rows.tolist(), b.tolist(), strict=True)) == [(i, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 97) for i, x in enumerate(lists) for t in x or ()]
