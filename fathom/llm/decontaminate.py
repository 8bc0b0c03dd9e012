"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fathom.llm.common import give_back
from fathom.runtime import materialize

#: Words of benchmark items in one automaton; a larger benchmark is worked through in blocks.
BLOCK_WORDS = 200_000

_SEPARATE = bytes(c if c > 0x7F or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``window`` consecutive words of an item are a window; an item of fewer words is one itself.
    After each word of a stream the automaton knows the longest match that ends there, and from
    the states on the way which windows do.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.items = window, [k for k, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        pairs: set[tuple[int, int]] = set()
        shorts: list[tuple[int, list[int]]] = []
        self.shortest = window
        for n, (_, words) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if not ids:
                continue
            if len(ids) < window:
                shorts.append((n, ids))
                self.shortest = min(self.shortest, len(ids))
            last = 0
            for a in ids:
                last = self._extend(last, a)
                while len(owners) < len(self.length):
                    owners.append(set())
                owners[last].add(n)
            pairs.update(zip(ids, ids[1:], strict=False))
        while len(owners) < len(self.length):
            owners.append(set())
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            # only states that hold a full window need to know their items
            if self.length[self.link[s]] >= window:
                owners[self.link[s]] |= owners[s]
        self.owners = owners
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for n, ids in shorts:
            s = 0
            for a in ids:
                s = self.next[s][a]
            self.whole.setdefault(s, []).append((len(ids), n))
        v = max(1, len(self.vocab))
        codes = np.fromiter((a * v + b for a, b in pairs), dtype=np.int64, count=len(pairs))
        self.size, self.table = v, None
        if v * v <= 1 << 26:
            self.table = np.zeros(v * v, dtype=bool)
            self.table[codes] = True
        self.codes = np.sort(codes)

    def _extend(self, last: int, a: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if a in nxt[last]:
            q = nxt[last][a]
            return q if length[q] == length[last] + 1 else self._clone(last, q, a)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and a not in nxt[p]:
            nxt[p][a] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][a]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, a)
        return cur

    def _clone(self, p: int, q: int, a: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(a) == q:
            nxt[p][a] = c
            p = link[p]
        return c

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a document that may hold a window: every pair of neighbours occurs in an item."""
        if len(ids) < self.shortest:
            return
        if self.shortest == 1:
            good = ids >= 0
            least = 1
        else:
            a, b = ids[:-1], ids[1:]
            good = (a >= 0) & (b >= 0)
            at = np.flatnonzero(good)
            code = a[at] * self.size + b[at]
            if self.table is not None:
                good[at] = self.table[code]
            elif len(self.codes):
                spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                good[at] = self.codes[spot] == code
            else:
                good[at] = False
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= least:
                yield x, y if self.shortest == 1 else y + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of every occurrence's words, joined where they touch, and the items' numbers."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for x, y in self._stretches(ids):
            s, n = 0, 0
            for i, a in enumerate(ids[x:y].tolist(), x + 1):
                while s and a not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if a in nxt[s]:
                    s = nxt[s][a]
                    n += 1
                hit, t, m = 0, s, n
                if m >= window:
                    hit = window
                    while length[link[t]] >= window:
                        t = link[t]
                    found |= self.owners[t]
                if self.whole:
                    t = s
                    while t > 0:
                        for k, item in self.whole.get(t, ()):
                            if k <= m:
                                hit = max(hit, k)
                                found.add(item)
                        t = link[t]
                        m = min(m, length[t]) if t >= 0 else 0
                if hit:
                    if spans and spans[-1][1] >= i - hit:
                        while len(spans) > 1 and spans[-2][1] >= i - hit:
                            spans.pop()
                        spans[-1] = [min(spans[-1][0], i - hit), i]
                    else:
                        spans.append([i - hit, i])
        return [(a, b) for a, b in spans], found


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int, window: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in the order of their ids, as many at a time as have ``block_words`` words. A longer item
    comes in pieces that overlap by a window less a word, so that each window is whole in one."""
    block, n = [], 0
    for row in items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).orderBy(F.col(f"`{item_id}`")).toLocalIterator():
        words, at = words_of(row[1]), 0
        step = max(1, block_words - window + 1)
        while at < len(words) and (at == 0 or len(words) - at >= window):
            piece = words[at : at + step + window - 1]
            if block and n + len(piece) > block_words:
                yield block
                block, n = [], 0
            block.append((row[0], piece))
            n += len(piece)
            at += step
    yield block


_built: dict[str, Automaton] = {}


def _automaton(items, key: str, window: int) -> Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items.value, window)
    return _built[key]


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words:bigint,spans:array<struct<a:int,b:int>>,items:array<string>>"


def _found(texts: pa.Array, auto: Automaton) -> list[dict]:
    out = []
    for t in texts.to_pylist():
        words = words_of(t)
        spans, found = auto.scan(words)
        out.append({"n_words": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted({str(auto.items[i]) for i in found})})
    return out


def _scanner(items, key: str, window: int):
    """For mapInArrow over (row, text): row and what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(items, key, window)
        for batch in batches:
            found = _found(batch.column(1), auto)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], names=["row", "found"])
        give_back()

    return run


def _hit_texts(items, key: str, window: int):
    """For mapInArrow over (text): hashes of the texts that something is found in, and that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(items, key, window)
        for batch in batches:
            found = _found(batch.column(2), auto)
            hit = [i for i, x in enumerate(found) if x["spans"]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int32())), batch.column(1).take(pa.array(hit, pa.int32())), pa.array([found[i] for i in hit], _FOUND)], names=["h", "g", "found"])

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (row, text, all): row and what all blocks found together."""
    for batch in batches:
        out = []
        for t, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = join_spans([(x["a"], x["b"]) for p in parts or () for x in p["spans"]])
            out.append({"n_words": len(words_of(t)), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted({i for p in parts or () for i in p["items"]})})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FOUND)], names=["row", "found"])


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, block_words: int) -> DataFrame:
    """(row, found): each row of ``docs`` as a struct, and what is found in its text."""
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL(f"found {_FOUND_DDL}").fields])
    blocks = _blocks(items, item_id, item_text, block_words, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return packed.mapInArrow(_scanner(spark.sparkContext.broadcast(first), uuid.uuid4().hex, window), schema)
    key = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    hashed, parts = packed.select(*key, "text"), []
    for block in chain([first, second], blocks):
        run = _hit_texts(spark.sparkContext.broadcast(block), uuid.uuid4().hex, window)
        parts.append(materialize(hashed.mapInArrow(run, f"h long, g long, found {_FOUND_DDL}").dropDuplicates(["h", "g"]), "hits"))
    found = reduce(DataFrame.union, parts).groupBy("h", "g").agg(F.collect_list("found").alias("all"))
    return packed.select(*key, "row", "text").join(found, ["h", "g"], "left").select("row", "text", "all").mapInArrow(_merger, schema)


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (array of word positions a, b), hit_items (array of string).

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. ``spans``
    cover every document word inside an occurrence of a window; ``hit_items`` are the items with
    windows that occur, sorted as strings. Documents stream past an automaton that each Python
    worker builds once from a broadcast of at most ``block_words`` item words, and then never move.
    A larger benchmark takes one pass a block, each of which keeps only what it finds, by the hash
    of the text; a last pass joins that to the documents.

    Null or empty texts have no words and no spans; null or empty items no windows; repeated items
    are each found. An empty table on either side gives no spans. Repeated rows are marked each.
    Input columns named like the new ones, in any case, give way to them.
    """
    out = _scan(docs, items, text, item_id, item_text, window, block_words)
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "hit_items")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("found.n_words").alias("n_words"), F.col("found.spans").alias("spans"), F.col("found.items").alias("hit_items"))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (row, text, spans): the text without the words of the spans and what is between them."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, cut in enumerate(batch.column(2).to_pylist()):
            if cut:
                where = [m.span() for m in _WORD.finditer(texts[i])]
                parts, done = [], 0
                for x in cut:
                    parts.append(texts[i][done : where[x["a"]][0]])
                    done = where[x["b"] - 1][1]
                texts[i] = "".join([*parts, texts[i][done:]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def remove_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the passages of ``items``: spans are cut out of the text, and a document of
    whose words more than ``max_coverage`` lie in spans goes altogether. Texts without spans stay as
    they are, nulls and repeated rows too; without items nothing is cut, and an empty table gives an
    empty table. Columns are those of ``docs``, whatever their names."""
    found = _scan(docs, items, text, item_id, item_text, window, block_words)
    covered = F.aggregate("found.spans", F.lit(0), lambda s, x: s + x["b"] - x["a"])
    stay = found.where((F.col("found.n_words") == 0) | (covered <= F.lit(max_coverage) * F.col("found.n_words")))
    cut = stay.select("row", F.col(f"row.`{text}`").alias("text"), "found.spans").mapInArrow(_cutter, StructType([stay.schema["row"], StructField("text", StringType())]))
    return cut.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
