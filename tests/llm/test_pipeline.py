import corpus_pipeline as pipeline
from fathom.llm.queries import vocabulary
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_they_say(spark):
    """Each stage against what plain Python makes of its input, on a small copy of documents."""
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontaminated", "mixed", "tokens"]
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = pipeline.materialize(stage(spark, docs, sf_dir), "test")
        if name != "tokens":
            assert docs.columns == COLUMNS
        after = docs.collect()
        if name == "quality":
            assert not any(brute.quality_figures(r["text"])[-1] for r in after) and 0 < len(after) < len(before)
        elif name == "near_duplicates":
            firsts = {d for d, _, c in brute.jaccard_components([(d, r["text"]) for d, r in before.items()]) if d == c}
            assert sorted(r["doc_id"] for r in after) == sorted(firsts)
        elif name == "decontaminated":
            hit = {d: h for d, _, h, *_ in brute.contamination([(d, r["text"]) for d, r in before.items()], items)}
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in after if not hit[r["doc_id"]])
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            assert {d for d, h in hit.items() if not h} <= {r["doc_id"] for r in after}
            left = brute.contamination([(r["doc_id"], r["text"]) for r in after], items)
            assert not any(h for _, _, h, *_ in left)
        elif name == "mixed":
            assert {r["doc_id"] for r in after} <= set(before) and all(r["text"] == before[r["doc_id"]]["text"] for r in after)
            mixed = after
    library = Tokenizer.from_file(vocabulary())
    got = sorted(map(tuple, after), key=lambda x: x[1])
    assert got == brute.tokens(sorted(((r["doc_id"], r["text"]) for r in mixed), key=lambda x: x[0]), library)


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_run_leaves_only_what_its_result_reads(spark):
    import pathlib

    work = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "fathom"
    before = set(work.iterdir()) if work.exists() else set()
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(work.iterdir()) - before)
    assert left == ["manifest", "stage-mixed", "tokens"]
