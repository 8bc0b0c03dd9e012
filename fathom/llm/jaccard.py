"""Exact Jaccard join of documents on word n-grams, up to connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.common import give_back, long_id
from fathom.llm.components import components
from fathom.runtime import discard, materialize

#: N-grams in one block whose counts a worker takes at a time, and the least count that it reports.
BLOCK, REPORTED = 2_000_000, 4
#: Frequent n-grams that workers get to know. They only order the columns of the matrix: any order
#: gives the same links, this one the fewest candidates.
FREQUENT = 200_000
NULL_ID = -(2**63)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _random(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, seed=seed) | 1 for i in range(n)], dtype=np.uint64)


_BYTES, _FACTORS = _random(256, 1), _random(64, 2)
_BYTES[65:91] = _BYTES[97:123]
_BASE = int(_random(1, 3)[0])
_BACK = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z as a-z: polynomials over the bytes, by differences of a running sum."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(_powers[0]) <= len(b):
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(2 * len(b) + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    edge = np.diff(np.concatenate(([True], _WHITE[b], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[b] * _powers[0][: len(b)])))
    return _mix((run[end] - run[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def gram_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word grams. Words are runs without ASCII white space,
    A-Z in lower case. Fewer than ``k`` words count as one gram, none as no gram."""
    w = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    n = len(w)
    if n == 0:
        return w
    if n < k:
        return _mix(np.array([(w * _FACTORS[:n]).sum() + np.uint64(n)], dtype=np.uint64))
    h = w[: n - k + 1] * _FACTORS[0]
    for i in range(1, k):
        h += w[i : n - k + 1 + i] * _FACTORS[i]
    h = _mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _survey(k: int):
    """Rows of documents (kind 0: id, size, fingerprint) and of n-grams frequent in a block (kind 1)."""

    def rows(kind: int, a, b, c, d) -> pa.RecordBatch:
        long = lambda x: pa.array(np.asarray(x).astype(np.uint64).view(np.int64) if not isinstance(x, pa.Array) else x)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), long(a), long(b), long(c), long(d)], names=["kind", "a", "b", "c", "d"])

    def frequent(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if block:
            gram, n = np.unique(np.concatenate(block), return_counts=True)
            often = n >= REPORTED
            zero = np.zeros(int(often.sum()), dtype=np.int64)
            yield rows(1, gram[often], n[often], zero, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            ids, texts = _column(batch, "__id"), _column(batch, "__text").to_pylist()
            n, lo, hi = [], [], []
            for t in texts:
                s = gram_set(t, k)
                x = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                lo.append(x & (2**64 - 1))
                hi.append(x >> 64)
                block.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield from frequent(block)
                    block, size = [], 0
            yield rows(0, ids, np.array(n, dtype=np.int64), np.array(lo, dtype=np.uint64), np.array(hi, dtype=np.uint64))
        yield from frequent(block)
        give_back()

    return run


def _order(grams: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the matrix's order of columns: rare first, then by hash."""
    known, counts = often
    if not len(known):
        return grams
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    n = np.where(known[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, n))]


#: One column in so many of a document's set is skipped, its most shared ones.
SKIP = 60


def _spare(n: int, percent: int) -> int:
    """Columns that a head has beyond the least: what the document skips, what its partner may skip
    (whose set is at most 100 / ``percent`` times as large), and as many again that must be shared."""
    return (2 * n + n * 100 // percent) // SKIP


def _heads(often, k: int, percent: int):
    """Leading columns of each document: enough that two documents that link share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for t in _column(batch, "__text").to_pylist():
                s = gram_set(t, k)
                probe = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                heads.append(_order(s, often.value)[: probe + _spare(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays([_column(batch, "__id"), pa.array(heads, pa.list_(pa.int64()))], names=["doc", "grams"])
        give_back()

    return run


def _overlaps(k: int):
    """Products of blocks of rows with one row: overlap counts of a document (lead) and those held
    against it. Input is sorted by lead and part, the lead's own row first in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            a, b, own = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("a", "doc", "own"))
            sets = [gram_set(t, k) for t in _column(batch, "text").to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            shared, lead_sizes = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
            edges = sorted({0, *np.flatnonzero(own).tolist()})
            for x, y in zip(edges, [*edges[1:], len(sets)], strict=True):
                if own[x]:
                    lead = sets[x]
                block = np.concatenate(sets[x:y])
                at = np.minimum(np.searchsorted(lead, block), len(lead) - 1)
                shared[x:y] = np.add.reduceat(lead[at] == block, np.cumsum(sizes[x:y]) - sizes[x:y], dtype=np.int64)
                lead_sizes[x:y] = len(lead)
            keep = ~own
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (a, b, shared, lead_sizes + sizes - shared)], names=["a", "b", "shared", "either"])
        give_back()

    return run


#: Pairs with one lead in a part, beyond which another task counts on.
PART = 500


def _counted(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, shared, either): sizes of the intersection and the union for each pair.

    Every document's text travels once, and once more for each part of the documents held against
    it, so neither a lead of many nor its text is one task's burden.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("doc"), F.lit(False).alias("own"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc"), F.lit(True).alias("own"))
    wide = members.union(leads).join(texts, F.col("doc") == F.col("__id")).select("a", "part", "doc", "own", F.col("__text").alias("text"))
    dealt = wide.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"), "doc")
    return dealt.mapInArrow(_overlaps(k), "a long, b long, shared long, either long")


def _pairs_by_leader(cells: DataFrame, shift: float, percent: int) -> DataFrame:
    """Within each column and size class, every document with the leading one, if not yet together.

    The document with most shared columns leads: an original whose copies were each changed
    elsewhere shares more than any copy. A document keeps the one leader that it shares most columns
    with.
    """
    cells = cells.withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25)) + F.lit(shift)))
    lead = F.max(F.struct("weight", F.bitwise_not("doc").alias("order"), "doc", "root", "n")).over(Window.partitionBy("gram", "class"))
    led = cells.withColumn("leader", lead).where("leader.doc <> doc and leader.root <> root")
    led = led.where(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n"))
    counts = led.groupBy("doc", F.col("leader.doc").alias("leader")).agg(F.count("*").alias("shared"), F.first("n").alias("size"))
    counts = counts.where(F.col("shared") > F.floor(F.col("size") / SKIP))
    best = counts.groupBy("doc").agg(F.max_by("leader", F.struct("shared", F.bitwise_not("leader"))).alias("leader"))
    return best.select(F.col("leader").alias("a"), F.col("doc").alias("b"))


def _open_documents(cells: DataFrame) -> DataFrame:
    """(doc, n, root) of documents that may still link with one they aren't together with.

    Two documents that need an overlap of m share at least l of their first n - m + l columns, for
    any l. Each skips its most shared columns, one in SKIP, so that common passages don't count;
    with l = 1 + what both skip + r, at least 1 + r shared columns are left to each.
    """
    column = Window.partitionBy("gram")
    mixed = cells.where("not skipped").withColumn("low", F.min("root").over(column)).withColumn("high", F.max("root").over(column)).where("low < high")
    per = mixed.groupBy("doc").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("root").alias("root"))
    return per.where(F.col("shared") > F.floor(F.col("n") / SKIP)).select("doc", "n", "root")


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t, k).view(np.int64) for t in _column(batch, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_column(batch, "__id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "grams"])
        give_back()

    return run


def _pairs_left(cells: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs that aren't together and can still link.

    Of the documents that are open, whole sets are ordered anew, by how many open documents have a
    column: what only one has comes first and pairs it with nobody. Two that need an overlap of m
    share one of their first n - m + 1 columns. Overlaps in these heads are counted column by
    column; with as many columns as both have beyond the last shared one, which is all that the
    rest can add, they must reach m, or the pair is dropped.
    """
    opened = materialize(_open_documents(cells), "open")
    whole = texts.join(opened, F.col("__id") == F.col("doc"), "left_semi").mapInArrow(_whole_sets(k), "doc long, grams array<long>")
    column, own = Window.partitionBy("gram"), Window.partitionBy("doc")
    counted = whole.select("doc", F.explode("grams").alias("gram")).withColumn("df", F.count("*").over(column)).where("df > 1")
    placed = counted.withColumn("place", F.row_number().over(own.orderBy("df", "gram"))).withColumn("all", F.count("*").over(own))
    placed = placed.join(opened, "doc").withColumn("i", (F.col("n") - F.col("all") + F.col("place") - 1).cast("int"))
    heads = materialize(placed.where(F.col("i") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).select("gram", "doc", "n", "root", "i"), "heads")
    x, y = heads.alias("x"), heads.alias("y")
    before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc") < F.col("y.doc")))
    sizes = F.col("x.n") * 100 >= F.col("y.n") * percent
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    room = (F.col("x.i") + need <= F.col("x.n")) & (F.col("y.i") + need <= F.col("y.n"))
    meet = x.join(y, (F.col("x.gram") == F.col("y.gram")) & before & sizes & room & (F.col("x.root") != F.col("y.root")))
    rest = F.least(F.min(F.col("x.n") - F.col("x.i")), F.min(F.col("y.n") - F.col("y.i"))) - 1
    pairs = meet.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg((F.count("*") + rest).alias("most"), F.first(need).alias("need"))
    pairs = materialize(pairs.where("most >= need").select("a", "b"), "pairs")
    discard(opened, heads)
    return pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, leaders: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) of each row: documents link when ``percent`` % or more of the
    union of their ``k``-gram sets is shared, exactly; component_id is the smallest id reachable.

    The matrix of documents by n-grams is multiplied with its transpose, block by block, as far as
    needed. Documents with equal sets are one row of the matrix from the start. Columns run from rare
    to frequent. Two rows link only if they share columns among their first ones, as many as their
    sizes say, so only such heads are multiplied column by column, and overlaps in them are counted;
    pairs that stay below the bound go. For the others a block of rows meets one row at a time and
    the overlaps are counted on. Candidates of a column come in rounds: first with one leader per
    column and size class, which joins a group of copies by as many pairs as it has members; what is
    together already needs no more pairs. A last round takes every pair that is still apart, so no
    link is lost. Texts that are alike, but not alike enough to link, can make as many pairs there
    as they are.

    Null and empty texts have an empty set and link with nothing. Rows that share an id are one
    document (its first text counts); null ids are one id, below all others. Ids are integers above -2^63. Repeated
    rows come out as often. Hashes have 64 bits. An empty table gives an empty table; other columns
    are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(long_id(docs, id_col), F.lit(NULL_ID)).alias("__id"), F.col(f"`{text}`").alias("__text"))
    survey = materialize(slim.mapInArrow(_survey(k), "kind int, a long, b long, c long, d long"), "grams")
    sets = survey.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), "c", "d")
    often = survey.where("kind = 1").groupBy(F.col("a").alias("gram")).agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    known = often["gram"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(known)
    often = spark.sparkContext.broadcast((known[by], often["n"].to_numpy(dtype=np.int64)[by]))

    reps = sets.where("n > 0").groupBy("c", "d").agg(F.min("doc").alias("rep"), F.first("n").alias("n"))
    sizes = reps.groupBy(F.col("rep").alias("doc")).agg(F.max("n").cast("int").alias("n"))
    heads = slim.mapInArrow(_heads(often, k, percent), "doc long, grams array<long>").join(sizes, "doc", "left_semi")
    column, own = Window.partitionBy("gram"), Window.partitionBy("doc")
    shared = heads.select("doc", F.explode("grams").alias("gram")).withColumn("first", F.min("doc").over(column)).withColumn("last", F.max("doc").over(column)).withColumn("df", F.count("*").over(column)).where("first < last").select("gram", "doc", "df")
    placed = shared.withColumn("place", F.row_number().over(own.orderBy(F.desc("df"), "gram"))).withColumn("all", F.count("*").over(own)).join(sizes, "doc")
    cells = materialize(placed.select("gram", "doc", "n", (F.col("all") / F.col("n")).alias("weight"), (F.col("place") <= F.floor(F.col("n") / SKIP)).alias("skipped")), "cells")
    texts = slim.join(cells.select(F.col("doc").alias("__id")).distinct(), "__id", "left_semi")
    texts = materialize(texts.groupBy("__id").agg(F.first("__text").alias("__text")), "candidates")

    links, tested, roots = None, [], None
    for turn in range(leaders + 1):
        if roots is None:
            now = cells.withColumn("root", F.col("doc"))
        else:
            now = cells.join(roots, F.col("doc") == F.col("node"), "left").select("gram", "doc", "n", "skipped", "weight", F.coalesce("root", "doc").alias("root"))
        if turn < leaders:
            pairs = _pairs_by_leader(now, turn % 2 / 2, percent)
            if links is not None:
                pairs = pairs.join(links.select("a", "b"), ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
        else:
            pairs = _pairs_left(now, texts, k, percent)
        new = materialize(_counted(pairs, texts, k).select("a", "b", (100 * F.col("shared") >= percent * F.col("either")).alias("linked")), "tested")
        discard(pairs)
        tested.append(new)
        links = new if links is None else links.union(new)
        if turn < leaders or not new.where("linked").isEmpty():
            last, roots = roots, components(links.where("linked"))
            if last is not None:
                discard(last)
    discard(cells, texts, *tested)

    named = sets.join(reps.drop("n"), ["c", "d"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    out = named.select("doc", F.col("n"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("root", "rep")).alias("root"))
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return out.select(real("doc").alias(id_col), F.col("n").alias("n_shingles"), real("root").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first, by id, of those it is linked with, directly
    or through others. Rows that repeat id and text stay once."""
    found = jaccard_components(docs, id_col, text, k, percent)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__first")).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col("__first")), "left_semi").dropDuplicates([id_col, text])
