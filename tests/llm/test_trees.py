"""Prefix trie, chat format and vector codes against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathom.llm import chat_format as C, prefix_trie as P, queries as Q, vector_codes as V

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def conversations(rows):
    """{conversation: [(role, text)]} in order; turns of one number don't occur here but as copies."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in held.items()}


def brute_trie(convs):
    members, texts = defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out[node] = (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, sha(ends))
    return out


def some_rows(seed=3):
    """Few words, so that starts are shared; copies, nulls, and one long conversation."""
    pick = random.Random(seed)
    rows = []
    for c in range(-5, 230):
        if c % 9 == 4:
            continue
        turns = [(None if t == 0 and c % 13 == 0 else t, pick.choice(["user", "assistant", None, "system", "tool|>"]) if t else "user", pick.choice(["", None, "hi", "hi\n", "é", "a b"])) for t in range(pick.randrange(1, 6))]
        rows += [(c, *t) for t in turns]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(3)]
    rows += [(900, t, "user", f"{t}") for t in range(400)] + [(901, t, "user", f"{min(t, 200)}") for t in range(300)]
    rows += [(900, 7, "user", "7"), (None, 1, "user", "nobody's")]
    rows += [(c, 0, "assistant", "alone") for c in range(501, 520)]
    pick.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return some_rows()


def test_trie_is_that_of_brute_force(spark, rows):
    paths = P.conversation_paths(table(spark, rows)).cache()
    ends = {bytes(r["node"]): r["ends_sha256"] for r in P.end_digests(paths).collect()}
    got = P.prefix_trie(paths).collect()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
    made = sorted((*(r[c] for c in columns), ends.get(bytes(r["node"]), sha(""))) for r in got if r["depth"])
    assert made == sorted(x for x in brute_trie(conversations(rows)).values() if x[1])
    root = next(r for r in got if not r["depth"])
    assert root["parent_conv_id"] is None and root["n_convs"] == len(conversations(rows))
    # intervals: numbers without gaps, children inside their parents, siblings apart
    at = {bytes(r["node"]): r for r in got}
    assert sorted(r["pre"] for r in got) == list(range(len(got)))
    for r in got:
        inside = [x for x in got if r["pre"] <= x["pre"] < r["until"]]
        assert r["n_children"] == sum(x["depth"] == r["depth"] + 1 for x in inside) and min(x["depth"] for x in inside) == r["depth"]
        if r["parent"] is not None:
            up = at[bytes(r["parent"])]
            assert up["pre"] < r["pre"] < r["until"] <= up["until"]


def test_rebuilt_conversations(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    convs, again = conversations(rows), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])
        again[c] = base[:h] + own[h:]
    assert any(not t for t in again.values())  # a conversation without turns
    got = Q.op11_prefix_trie(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_trie(again).values()))


def test_ids_of_a_node_are_hashed_in_blocks():
    node = [b"a" * 16] * 30_000 + [b"b" * 16]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(node), "conv": pa.array([*range(30_000), 5])})
    packed = list(P._pack(iter([batch.slice(0, 11_000), batch.slice(11_000)])))
    assert sum(b.num_rows for b in packed) > 3
    got = [r for b in P._digest(iter(packed)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in got] == [sha(",".join(map(str, range(30_000)))), sha("5")]


@pytest.mark.parametrize("make", [P.conversation_trie, lambda r: C.format_conversations(r)[0], lambda r: C.format_conversations(r)[1], lambda r: C.conversation_digests(r.sparkSession, C.write_conversations(r))], ids=["trie", "segments", "members", "digests"])
def test_empty_and_clashing(spark, rows, make):
    few = table(spark, rows[:80])
    assert make(few.where("false")).count() == 0
    clash = ["node", "PRE", "conv", "key", "path", "depth", "start", "place", "__base_pre", "a.b", "part", "at"]
    wide = few.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    assert sorted(map(str, make(wide).collect())) == sorted(map(str, make(few).collect()))
    with pytest.raises(TypeError):
        make(few.withColumn("conv_id", F.lit("x")))


def test_chat_sequence_and_its_mask(spark, rows):
    segments, members = C.format_conversations(table(spark, rows))
    segs, convs = sorted(segments.collect(), key=lambda r: r["start"]), conversations(rows)
    assert len(segs) == len({tuple(t[:d]) for t in convs.values() for d in range(1, len(t) + 1)})  # each shared turn once
    assert [s["start"] for s in segs] == np.cumsum([0, *[len(s["text"]) for s in segs]])[:-1].tolist()
    assert [s["pre"] for s in segs] == sorted(s["pre"] for s in segs)
    last = {r["conv_id"]: r["pre"] for r in members.collect()}
    assert set(last) == set(convs)
    for c, pre in last.items():
        at = next(s for s in segs if s["pre"] == pre)
        seen = [s for s in segs if s["start"] <= at["start"] < s["until"]]  # what the mask lets it attend to
        assert [C.parse_turn(s["text"]) for s in seen] == convs[c]
        assert C.split_turns("".join(s["text"] for s in seen)) == [s["text"] for s in seen]
        assert [s["position"] for s in seen] == np.cumsum([0, *[len(s["text"]) for s in seen]])[:-1].tolist()
        learnt = [C.unescape(s["text"][s["loss_from"] : s["loss_to"]]) for s in seen if s["loss_from"] is not None]
        assert learnt == [t for r, t in convs[c] if r == "assistant"]


def test_chat_is_read_back(spark, rows, monkeypatch):
    folder = C.write_conversations(table(spark, rows))
    for size in (1 << 22, 100):  # few parts, and many that trees reach across
        monkeypatch.setattr(C, "PART_CHARS", size)
        got = {r["conv_id"]: tuple(r)[1:] for r in C.conversation_digests(spark, folder).collect()}
        for c, turns in conversations(rows).items():
            learnt = "".join(t for r, t in turns if r == "assistant")
            assert got[c][:4] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
        assert len(got) == len(conversations(rows))


def test_chat_in_token_ids(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.vocabulary())
    folder = C.write_conversations(table(spark, rows), tokenizer=Q.vocabulary())
    segs = sorted(spark.read.parquet(f"{folder}/segments").collect(), key=lambda r: r["start"])
    decode = lambda ids: library.decode(list(ids), skip_special_tokens=False)
    assert [s["start"] for s in segs] == np.cumsum([0, *[len(s["ids"]) for s in segs]])[:-1].tolist()
    last = {r["conv_id"]: r["pre"] for r in spark.read.parquet(f"{folder}/members").collect()}
    for c, turns in conversations(rows).items():
        at = next(s for s in segs if s["pre"] == last[c])
        seen = [s for s in segs if s["start"] <= at["start"] < s["until"]]
        assert [decode(s["ids"]) for s in seen] == [s["text"] for s in seen] and len(seen) == len(turns)
        assert [s["position"] for s in seen] == np.cumsum([0, *[len(s["ids"]) for s in seen]])[:-1].tolist()
        learnt = [C.unescape(decode(s["ids"][s["ids_from"] : s["ids_to"]])) for s in seen if s["ids_from"] is not None]
        assert learnt == [t for r, t in turns if r == "assistant"]
    got = {r["conv_id"]: r["n_turns"] for r in C.conversation_digests(spark, folder).collect()}
    assert got == {c: len(t) for c, t in conversations(rows).items()}


PIECES = ["<s>", "</s>", "<", ">", "|", "[", "]", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n\n", "<|", "|>", "<|end|>", "\\", "s", "/", "x", " ", "é"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a|>b", "<s>"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=4), st.data())
@settings(max_examples=300, deadline=None)
def test_marks_are_reversible(turns, data):
    """The escaping in plain Python, which test_escaping_in_spark holds against the columns'."""
    import re

    control = re.compile(C.CONTROL)
    escaped = lambda t: control.sub(lambda m: m[0] + "\\", t.replace("\\", "\\\\"))

    def written(role, text):
        head, foot = C.MARKS.get(role, (C.OTHER[0] + escaped(role) + C.OTHER[1], C.OTHER[2]))
        assert not re.search(r"</?s>|<</?SYS>>|\[/?INST\]|<\||\|>", escaped(text))
        return head + escaped(text) + foot

    each = [written(*t) for t in turns]
    assert C.split_turns("".join(each)) == each and [C.parse_turn(x) for x in each] == turns


def test_escaping_in_spark(spark):
    pick = random.Random(1)
    texts = ["".join(pick.choices(PIECES, k=8)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", C.escape(F.col("text")).alias("e")).collect()
    assert all(C.unescape(r["e"]) == r["text"] for r in rows) and any("\\" in r["text"] for r in rows)


@given(st.data(), st.integers(1, 40), st.integers(1, 4), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_tree_finds_what_a_scan_finds(data, n, wide, leaf):
    numbers = st.integers(-4, 4) | st.integers(-(2**27), 2**27)
    entries = np.array(data.draw(st.lists(st.lists(numbers, min_size=wide, max_size=wide), min_size=n, max_size=n)), dtype=np.int64)
    points = np.array(data.draw(st.lists(st.lists(numbers, min_size=wide, max_size=wide), min_size=1, max_size=30)), dtype=np.int64)
    index, far = V.KdTree(entries, leaf).nearest(points)
    all_ = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert index.tolist() == all_.argmin(axis=1).tolist() and far.tolist() == all_.min(axis=1).tolist()


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i is None, i or 0, x, i, lab) for i, x, lab in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)), key=lambda r: r[:3])
    ints = [[int(np.floor(256 * np.float64(v))) for v in r[2]] for r in kept]
    w = len(ints[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for x in ints] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda b, x: min((sum((a - y) ** 2 for a, y in zip(e, x, strict=True)), i) for i, e in enumerate(b))
    for _ in range(rounds):
        for c, b in zip(cut, books, strict=True):
            mine = defaultdict(list)
            for x in c:
                mine[near(b, x)[1]].append(x)
            for e, xs in mine.items():
                b[e] = [sum(v) // len(xs) for v in zip(*xs, strict=True)]
    out = [(r[3], "".join(f"{near(b, c[n])[1]:02x}" for c, b in zip(cut, books, strict=True)), sum(near(b, c[n])[0] for c, b in zip(cut, books, strict=True)), r[4]) for n, r in enumerate(kept)]
    per = defaultdict(int)
    for _, _, e, lab in out:
        per[lab] += e
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    return sorted((str(i), c, e, per[lab], digest) for i, c, e, lab in out)


@pytest.mark.parametrize("n", [5, 40, 700])
def test_codes_are_those_of_brute_force(spark, n):
    pick = np.random.default_rng(n)
    rows = [(i, pick.normal(size=32).astype("float32").tolist(), [None, 1, 1, 2][i % 4]) for i in range(n)]
    rows += [(i, rows[i % 3][1], 7) for i in range(n, n + 9)] + [(2, rows[2][1], 1), (None, rows[1][1], None)]
    rows += [(n + 50, None, 1), (n + 51, [None, *[0.0] * 31], 1), (n + 52, [float("nan"), *[0.0] * 31], 1), (n + 53, [float("-inf"), *[0.0] * 31], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    wide = frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["id", "VECTOR", "code", "error", "of", "a.b"])])
    got = V.code_digests(wide, parts=16, entries=64, rounds=2)
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == brute_codes(rows, 16, 64, 2)


def test_vectors_that_cannot_be_compressed(spark):
    frame = lambda *v: spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    assert V.code_digests(frame(None)).count() == 0 and V.code_digests(frame([0.0] * 16).where("false")).count() == 0
    for bad in ([[0.0] * 16, [0.0] * 32], [[0.0] * 17], [[1e30] * 16], [[]]):
        with pytest.raises(ValueError, match="components|component of"):
            V.code_digests(frame(*bad))


def test_decoded_vectors_are_near(spark):
    pick = np.random.default_rng(1)
    middles = pick.normal(size=(20, 32))
    x = (middles[np.arange(400) % 20] + 0.02 * pick.normal(size=(400, 32))).astype("float32")
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    codes, books = V.compress(frame)
    rows = sorted(codes.collect())
    made = V.decode(np.array([r["code"] for r in rows]), books)
    assert np.square(made - x).mean() < 0.02 * np.square(x).mean()
