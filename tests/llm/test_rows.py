import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm.decontaminate import mark_contamination, remove_contamination
from fathom.llm.line_dedup import drop_frequent_lines
from fathom.llm.mixing import draw_mix, mix_sources, source_targets
from fathom.llm.quality import judge_quality
from fathom.llm.queries import op8_decontaminate, vocabulary
from fathom.llm.token_files import Encoder, Memory, read_token_files, token_digests, write_token_files
from tests.llm import brute


def test_frequent_lines_go(spark):
    r = random.Random(1)
    lines = ["Same  line", " same  LINE\t", "é", "", "  ", "rare {}", "\x0bx\x0c", "twice\ntwice"]
    texts = ["\n".join(r.choice(lines).format(i) for _ in range(r.randint(0, 9))) for i in range(40)] + [None, "", "\n"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    out = drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, out)) == sorted(brute.line_dedup(list(enumerate(texts))))
    assert drop_frequent_lines(docs.where("false")).count() == 0
    assert drop_frequent_lines(spark.createDataFrame([(None, "k")] * 10, "doc_id long, text string")).where("text = ''").count() == 10


def test_targets_stop_at_three_times_the_source(spark):
    rows = [("a", 100), ("b", 5000), ("c", 1000), (None, 10), ("d", 0)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total, free, weight = 6110.0, dict(rows), {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    target, left = {}, total
    while True:
        level = left / sum(weight[k] for k in free)
        full = [k for k in free if level * weight[k] > 3 * dict(rows)[k]]
        if not full:
            break
        for k in full:
            target[k] = 3.0 * dict(rows)[k]
            left -= target[k]
            del free[k]
    target |= {k: level * weight[k] for k in free}
    assert got == pytest.approx(target)


def test_mix_comes_near_its_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 5, 30, 200]), r.choice(["a", "b", "b", "b", None])) for i in range(600)] + [(600, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    out = mix_sources(docs).collect()
    assert len(out) == len(rows) and sorted(out, key=str) == sorted(mix_sources(docs.repartition(5)).collect(), key=str)
    for s in ("a", "b", None):
        own = [x for x in out if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 100  # half of the longest document
        assert own[0]["source_size"] == sum(x["size"] for x in own)
    assert all(x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"] for x in out)
    assert draw_mix(docs).count() == sum(x["copies"] for x in out)
    assert mix_sources(docs.where("false")).count() == 0


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_contamination_matches_brute_force(spark, block_words):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "d3", "é", "zeta"]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([12, 14, 3, 1, 0, 11, 25, 10])] + [(8, None), (9, "alpha, beta; gamma"), (3, "unique")]
    for short in (True, False):
        bench = [x for x in items if short or len((x[1] or "").split()) >= 10]
        docs = [(i, " ".join(r.choice(words) for _ in range(n)) + " " + (r.choice(bench)[1] or "") + " tail-" + r.choice(words)) for i, n in enumerate([0, 3, 40, 200] * 5)] + [(99, None), (98, "")]
        frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
        found = mark_contamination(frame, spark.createDataFrame(bench, "item_id long, text string"), block_words=block_words)
        got = {x["doc_id"]: (x["n_words"], sum(s["b"] - s["a"] for s in x["spans"]), set(x["hit_items"])) for x in found.collect()}
        want = {d: (n, h, k) for d, n, h, k, *_ in brute.contamination(docs, bench)}
        assert {d: (n, h, len(k)) for d, (n, h, k) in got.items()} == want
    assert mark_contamination(frame, spark.createDataFrame([], "item_id long, text string")).where("size(spans) > 0").count() == 0


def test_contamination_is_cut_out(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Keep this, {item.upper()}! and that and so on and on and on and on"), (2, item), (3, "clean"), (4, None)]
    out = remove_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Keep this, ! and that and so on and on and on and on", 3: "clean", 4: None}


ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\na\n", "l'été d'un I'll don't 's", "x y", "日本語 テキスト", "a\tb", "1,234.5 ½ ²", "<|endoftext|> x<|endoftext|>y", "​　 z", "a  b", "Ünï cödé ªº ×÷", "\U0001F600 ok", "foo###bar &&& $$$", "\r\n x", "tail\n", "İ ſ K"]


def test_encoder_is_the_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    r = random.Random(4)
    parts = ["a", "B", " ", "\n", "é", ".", "'s", "7", "\t", "ß", "<", " ", "\x01", "’", "½,"]
    for memory, wide, most in ((10**6, 30, 500), (3_000, 12, 2_000)):
        own.memory = Memory(memory)
        texts = ODD + ["".join(r.choice(parts) for _ in range(wide)) for _ in range(most)] + [" ".join("".join(r.choice("aé'!.7") for _ in range(4)) for _ in range(40)) + "\n"]
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype=own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = [(3 * i - 20, t) for i, t in enumerate([*ODD, None, "word " * 3000])]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, start string").repartition(4)
    folder, manifest = write_token_files(docs, vocabulary())
    assert sorted(map(tuple, token_digests(spark, folder).collect())) == brute.tokens(rows, library)
    ids = {r["doc_id"]: r["ids"] for r in read_token_files(spark, folder).collect()}
    assert all(ids[d] == [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows)
    assert manifest.agg(F.sum("n_ids")).first()[0] == sum(map(len, ids.values()))
    folder, _ = write_token_files(docs.where("false"), vocabulary())
    assert token_digests(spark, folder).count() == 0
    twice = spark.createDataFrame([(1, "b"), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    out = token_digests(spark, write_token_files(twice, vocabulary())[0]).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 1, 1, 1] and [r["start"] for r in out] == [0, 2, 4, 6]
    assert out[1]["ids_crc32"] == out[2]["ids_crc32"] != out[3]["ids_crc32"] != zlib.crc32(b"")


def test_quality_tells_junk_from_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = judge_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    both = judged.where("not base_failed").select("doc_id", "kept").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    right = sum(r["kept"] == (r["label"] == 1) for r in both) / len(both)
    assert right >= 0.97
    assert all(r["kept"] for r in both if r["label"] == 1)


def test_decontamination_query_runs(spark):
    out = op8_decontaminate(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and out.where("contaminated").count() > 0
