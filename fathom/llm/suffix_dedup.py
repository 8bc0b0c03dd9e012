"""Removal of byte strings that an earlier document has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.common import long_id
from fathom.llm.suffixes import common_prefix_reaches, suffix_array, words_at
from fathom.runtime import discard, materialize

#: Bytes of the grams that anchor a string: every string's smallest gram, by hash, is its anchor.
GRAM = 20
#: Documents that hold an anchor from which on its strings are dealt out one by one.
HOT = 20_000
#: Bytes of distinct passages in one suffix array, but for a single anchor's.
BLOCK = 2_000_000
NULL_ID = -(2**63)
#: Texts that a task remembers to skip copies.
SEEN = 200_000


def anchors(text: bytes, length: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes, the smallest hash among its grams."""
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    m = len(text) - GRAM + 1
    w = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=text, strides=(1,)).astype(np.uint64)
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15) + w[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F) + (w[GRAM - 8 : GRAM - 8 + m] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    wide, got = length - GRAM + 1, 1
    while got * 2 <= wide:
        h = np.minimum(h[:-got], h[got:])
        got *= 2
    if got < wide:
        h = np.minimum(h[: len(h) - (wide - got)], h[wide - got :])
    return h


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            grams, ids = [], []
            for key, t in zip(_column(batch, "__id").to_pylist(), _column(batch, "__text").to_pylist(), strict=True):
                b = (t or "").encode("utf-8", "surrogatepass")
                x = xxhash.xxh3_128_intdigest(b)
                if seen.get(x, key) < key:
                    continue  # a copy of an earlier document, for sure
                if len(seen) < SEEN or x in seen:
                    seen[x] = key
                own = np.unique(anchors(b, length))
                grams.append(own.view(np.int64))
                ids.append(np.full(len(own), key, dtype=np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(ids))], names=["anchor", "doc"])

    return run


def _passages(length: int):
    """Runs of string starts with one anchor, as far as another document has it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            anchor, passage, pieces, where, lead = [], [], [], [], []
            ids, texts = _column(batch, "__id").to_pylist(), _column(batch, "__text").to_pylist()
            grams = [_lists(_column(batch, c)) for c in ("common", "hot")]
            sizes = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                b = (t or "").encode("utf-8", "surrogatepass")
                a = anchors(b, length)
                if not len(a):
                    continue
                edges = np.flatnonzero(a[1:] != a[:-1]) + 1
                first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(a)]))
                key = a[first].view(np.int64)
                warm, glow = (_among(key, g[i]) for g in grams)
                if glow.any():
                    # strings of a hot anchor go one by one, under the string's own hash
                    own = np.concatenate([np.arange(x, y) for x, y in zip(first[glow], last[glow], strict=True)])
                    names = np.array([xxhash.xxh3_64_intdigest(b[x : x + length], seed=1) for x in own.tolist()], dtype=np.uint64).view(np.int64)
                    first, last, key = np.concatenate((first[warm], own)), np.concatenate((last[warm], own + 1)), np.concatenate((key[warm], names))
                else:
                    first, last, key = first[warm], last[warm], key[warm]
                new = [b[x:y] for x, y in zip(first.tolist(), (last + length - 1).tolist(), strict=True)]
                pieces += new
                for n in map(xxhash.xxh3_64_intdigest, new):
                    passage.append(n)
                    # only a task's first and smaller documents of a passage can be its smallest
                    lead.append(met.get(n, ids[i] + 1) > ids[i])
                    if lead[-1] and (n in met or len(met) < SEEN):
                        met[n] = ids[i]
                anchor.append(key)
                where.append(first)
                sizes[i] = len(new)
            at = pa.array(np.repeat(np.arange(len(texts)), sizes))
            names = pa.array(np.array(passage, dtype=np.uint64).view(np.int64))
            none = np.empty(0, dtype=np.int64)
            columns = [pa.array(np.concatenate([none, *anchor])), names, pa.array(pieces, pa.binary()), _column(batch, "__id").take(at), _column(batch, "__hash").take(at), pa.array(np.concatenate([none, *where]).astype(np.int32)), pa.array(lead, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "passage", "bytes", "doc", "hash", "at", "lead"])

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The items of a list column, row by row; null is none."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _first_holders(length: int):
    """For each distinct passage, runs of its string starts with the smallest document that has the
    string. Input is sorted by anchor, passage and document."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor = np.array([r[0] for r in rows], dtype=np.int64)
        least = np.array([r[3] for r in rows], dtype=np.int64)
        sizes = np.array([len(r[2]) for r in rows])
        # an anchor's only passage has nothing to be sorted against
        near = anchor[1:] == anchor[:-1]
        some = np.concatenate((near, [False])) | np.concatenate(([False], near))
        out = [(r, [(0, int(sizes[r]), int(least[r]))]) for r in np.flatnonzero(~some).tolist()]
        many = np.flatnonzero(some)
        if len(many):
            wide = sizes[many] + 1
            begin = np.concatenate(([0], np.cumsum(wide)))[:-1]
            text = np.frombuffer(b"\0".join([rows[r][2] for r in many.tolist()]) + b"\0", dtype=np.uint8)
            words = words_at(text)
            owner = np.repeat(np.arange(len(many)), wide)
            left = (begin + wide - 1)[owner] - np.arange(len(text))
            order = suffix_array(text, length, words)
            order = order[left[order] >= length]
            starts = np.flatnonzero(np.concatenate(([True], ~common_prefix_reaches(words, order, length))))
            group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(order)]))))
            holder = np.full(len(text), np.iinfo(np.int64).max)
            holder[order] = np.minimum.reduceat(least[many][owner[order]], starts)[group]
            for r, x in zip(many.tolist(), begin.tolist(), strict=True):
                h = holder[x : x + int(sizes[r]) - length + 1]
                edges = (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist()
                out.append((r, [(p, q + length - 1, d) for p, q, d in zip([0, *edges], [*edges, len(h)], h[[0, *edges]].tolist(), strict=True)]))
        keep = [r for r, _ in out]
        runs = pa.array([[{"x": p, "y": q, "d": d} for p, q, d in x] for _, x in out], pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("d", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array([rows[r][1] for r in keep], pa.int64()), runs], names=["anchor", "passage", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*[_column(batch, c).to_pylist() for c in ("anchor", "passage", "bytes", "doc")], strict=True):
                if rows and rows[-1][:2] == r[:2]:
                    continue
                if size >= BLOCK and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield solve(rows)

    return run


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for t, cut, whole in zip(_column(batch, "__text").to_pylist(), _column(batch, "cut").to_pylist(), _column(batch, "copy").to_pylist(), strict=True):
                b = (t or "").encode("utf-8", "surrogatepass")
                joined: list[list[int]] = []
                for x, y in [(0, len(b))] if whole else sorted((c["x"], c["y"]) for c in cut or ()):
                    if joined and x <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], y)
                    else:
                        joined.append([x, y])
                parts, done = [], 0
                for x, y in joined:
                    parts.append(b[done:x])
                    done = y
                sizes.append(len(b))
                spans.append([{"x": x, "y": y} for x, y in joined])
                kept.append(b"".join([*parts, b[done:]]))
            pair = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
            yield pa.RecordBatch.from_arrays([_column(batch, "__id"), pa.array(sizes, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return run


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, spans, kept) of each row: ``kept`` is the UTF-8 text without every byte that
    lies in a string of ``length`` bytes which also starts in a row of a smaller id; ``spans`` are the
    removed runs (x, y) in bytes. Strings are judged on the input.

    No suffix array of the whole corpus is ever in one place. Equal strings have equal anchors (the
    smallest gram hash inside), so strings are dealt out by anchor: neighbouring starts with one
    anchor travel as one passage. Only anchors that two documents have go that far, copies of a whole
    text stay behind with their first document, and passages of equal bytes are one with the
    smallest of their documents, as far as each task can tell before anything is shuffled. Each task sorts blocks of distinct passages into a
    suffix array by two-stage sorting; neighbours with a common prefix of ``length`` bytes are one
    string, and its smallest document decides. Strings of an anchor that more than HOT documents have
    are dealt out one by one, so no group grows with the corpus.

    Null counts as empty. A row doesn't lose what only rows of its own id have. Null ids are one id,
    below all others. Ids are integers above -2^63. Hashes of 64 bits name passages within an anchor; strings are compared by
    bytes. An empty table gives an empty table; other columns are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings need {GRAM + 8} bytes or more")
    slim = docs.select(F.coalesce(long_id(docs, id_col), F.lit(NULL_ID)).alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    hashed = slim.select("__id", F.xxhash64("__text").alias("__hash"), F.md5("__text").alias("h"), F.octet_length("__text").alias("size")).where(F.col("size") >= length)
    same = hashed.groupBy("h", "size").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last")
    copies = hashed.join(same, ["h", "size"]).where("__id > first").select(F.col("__id").alias("doc"), F.col("__hash").alias("hash")).distinct()
    copies = materialize(copies, "copies")

    rows = slim.mapInArrow(_anchor_rows(length), "anchor long, doc long")
    by = Window.partitionBy("anchor")
    rows = rows.withColumn("least", F.min("doc").over(by)).withColumn("most", F.max("doc").over(by)).withColumn("n", F.count("*").over(by)).where("least < most")
    shared = rows.groupBy("doc").agg(F.collect_list(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("common"), F.collect_list(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    shared = materialize(shared, "anchors")

    texts = slim.withColumn("__hash", F.xxhash64("__text"))
    first_table = shared
    shared = shared.join(copies.groupBy("doc").agg(F.collect_set("hash").alias("same")), "doc", "left")
    wide = texts.join(shared, F.col("__id") == F.col("doc")).where(F.col("same").isNull() | ~F.array_contains("same", F.col("__hash")))
    made = wide.select("__id", "__hash", "__text", "common", "hot").mapInArrow(_passages(length), "anchor long, passage long, bytes binary, doc long, hash long, at int, lead boolean")
    made = materialize(made, "passages")
    discard(first_table)
    each = made.where("lead").select("anchor", "passage", "bytes", "doc").repartition("anchor").sortWithinPartitions("anchor", "passage", "doc")
    held = each.mapInArrow(_first_holders(length), "anchor long, passage long, runs array<struct<x:int,y:int,d:long>>")
    held = materialize(held, "holders")
    cut = made.select("anchor", "passage", "doc", "hash", "at").join(held, ["anchor", "passage"])
    cut = cut.select("doc", "hash", F.explode(F.filter(F.transform("runs", lambda r: F.struct((F.col("at") + r["x"]).alias("x"), (F.col("at") + r["y"]).alias("y"), r["d"].alias("d"))), lambda r: r["d"] < F.col("doc"))).alias("r"))
    cut = cut.groupBy("doc", "hash").agg(F.collect_set(F.struct("r.x", "r.y")).alias("cut"))
    whole = copies.select("doc", "hash", F.lit(True).alias("copy"))
    cut = materialize(cut.join(whole, ["doc", "hash"], "full_outer"), "cuts")
    discard(made, held, copies)

    final = texts.join(cut, (F.col("__id") == F.col("doc")) & (F.col("__hash") == F.col("hash")), "left").select("__id", "__text", "cut", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = final.mapInArrow(_cut(), "id long, n_bytes long, spans array<struct<x:int,y:int>>, kept binary")
    return out.select(F.nullif(F.col("id"), F.lit(NULL_ID)).alias(id_col), "n_bytes", "spans", "kept")


def string_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What each row loses, in figures, with the hash of what stays. Nulls, repeated rows and empty
    tables are as in ``drop_repeated_strings``."""
    out = drop_repeated_strings(docs, id_col, text)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["y"] - x["x"])
    return out.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
