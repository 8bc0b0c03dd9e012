"""Vector code compression: product quantization in integers, with a kd-tree for each codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathom.runtime import materialize

#: Components times this, rounded down, are the integers that are compressed.
SCALE = 256
#: Entries in a leaf of a tree; vectors that are assigned at a time.
LEAF, BLOCK_ROWS = 8, 8_192


class KdTree:
    """Nearest entry of one codebook, for many points at once, in integers.

    Inner nodes split at a component; a leaf holds the indexes of at most ``leaf`` entries. The search
    goes to the nearer side first and to the other if it may hold an entry as near as the best so
    far; equal bounds are visited, and of equal distances the lower index stays, so the answer is that
    of a scan over all entries.
    """

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.root = self._grow(np.arange(len(entries)), leaf)

    def _grow(self, at: np.ndarray, leaf: int):
        part = self.entries[at]
        spread = part.max(axis=0) - part.min(axis=0) if part.size else np.zeros(1)
        if len(at) <= leaf or spread.max() == 0:
            return at
        axis = int(spread.argmax())
        order = at[np.argsort(part[:, axis], kind="stable")]
        values = self.entries[order, axis]
        middle = int(np.searchsorted(values, values[len(order) // 2]))
        if middle == 0:  # equal components stay on one side
            middle = int(np.searchsorted(values, values[0], side="right"))
        return axis, int(values[middle - 1]), int(values[middle]), self._grow(order[:middle], leaf), self._grow(order[middle:], leaf)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each point."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), len(self.entries), dtype=np.int64)
        self._visit(self.root, points, np.arange(len(points)), best, found)
        return found, best

    def _visit(self, node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for index in node.tolist():
                d = ((points[rows] - self.entries[index]) ** 2).sum(axis=1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (index < found[rows]))
                best[rows[nearer]], found[rows[nearer]] = d[nearer], index
            return
        axis, low_end, high_start, low, high = node
        x = points[rows, axis]
        below = x - low_end < high_start - x
        for near, far, mine in ((low, high, below), (high, low, ~below)):
            own, at = rows[mine], x[mine]
            self._visit(near, points, own, best, found)
            gap = np.maximum(high_start - at, 0) if near is low else np.maximum(at - low_end, 0)
            self._visit(far, points, own[gap * gap <= best[own]], best, found)


def _integers(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    """The vectors of a batch, in integers."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
    return np.floor(x * float(SCALE)).astype(np.int64)


def _assigned(trees: list[KdTree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of vectors, a column for each part."""
    codes = np.empty((len(vectors), len(trees)), dtype=np.int64)
    far = np.empty_like(codes)
    for p, (tree, part) in enumerate(zip(trees, np.split(vectors, len(trees), axis=1), strict=True)):
        codes[:, p], far[:, p] = tree.nearest(part)
    return codes, far


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def usable(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``rows`` whose vector isn't null and has neither null nor non-finite components."""
    vector = F.col(f"`{embedding}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def train_codebooks(vectors: DataFrame, dim: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """A codebook (entries x components, integers) for each part of the ``vectors`` (id, label, vector).

    They start as the parts of the vectors of the smallest ids. In each round a kd-tree of every
    codebook goes to all tasks (parts x entries x components numbers, whatever the table), each task
    adds up the vectors that it assigns to an entry, Spark adds up the tasks' sums, and an entry
    becomes the sum by the count, rounded down; one that no part is assigned to stays. Only sums
    come to the driver: as many numbers as the codebooks hold.
    """
    spark, wide = vectors.sparkSession, dim // parts
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = np.concatenate([_integers(b, 0, dim) for b in first.to_batches()])
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees, shape=(parts, len(start), wide)) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
            for block in _blocks(batches):
                x = _integers(block, 0, dim)
                codes, _ = _assigned(trees.value, x)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p * wide : (p + 1) * wide])
                    count[p] += np.bincount(codes[:, p], minlength=shape[1])
            p, e = np.nonzero(count)
            used, at = len(p), np.arange(shape[2])
            yield pa.RecordBatch.from_pydict({"part": np.repeat(p, shape[2]), "entry": np.repeat(e, shape[2]), "place": np.tile(at, used), "total": total[p, e].ravel(), "n": np.repeat(count[p, e], shape[2])})

        summed = vectors.select("vector").mapInArrow(sums, "part long, entry long, place long, total long, n long")
        summed = summed.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in summed.collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        trees.unpersist()
    return books


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks): (id, label, code, error) of every vector of ``rows``, and each part's codebook.

    A component x counts as the integer floor(256 x). Vectors are cut into ``parts`` equal parts;
    ``code`` has the index of the entry nearest to each part, the lower one of equally near ones, and
    ``error`` is the sum of the squared distances. Vectors that are null, or hold a null or a component
    that isn't finite, are left out. Repeated rows are vectors each; a null id is an id, the last.
    All other vectors must have the same number of components, a multiple of ``parts``, and these must be
    so small that squared distances fit in 64 bits (2**19 at 64 components): else ValueError. An empty
    table gives empty codes and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    vectors = usable(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("vector")), "vector")
    size = F.size("vector")
    n, dim, longest, largest = vectors.agg(F.count("*"), F.min(size), F.max(size), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if not n:
        empty = vectors.select("id", "label", F.lit(None).cast("array<long>").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty, [np.empty((0, 0), dtype=np.int64)] * parts
    if dim != longest or not dim or dim % parts:
        raise ValueError(f"vectors of {dim} to {longest} components don't make {parts} equal parts")
    if dim * (2 * int(largest * SCALE) + 2) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest} is too large")
    books = train_codebooks(vectors, dim, parts, entries, rounds)
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, far = _assigned(trees.value, _integers(block, 2, dim))
            each = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), each, pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    codes = vectors.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code array<long>, error long")
    return materialize(codes, "codes"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors (in components, not integers) that codes stand for: the middle of what rounds down to each."""
    return (np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1) + 0.5) / SCALE


def code_digests(rows: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", **settings: int) -> DataFrame:
    """(id, code in hexadecimal, error, label_error, codebooks_sha256) of every vector that ``compress``
    keeps. ``label_error`` adds up the errors of a label, those without one together; a label that many
    vectors share is summed in parts and joined by splitting. Nulls, repeats and empties are as there."""
    codes, books = compress(rows, id_col=id_col, embedding=embedding, label=label, **settings)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    per = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    wide = codes.join(per, F.col("label").eqNullSafe(F.col("of")))
    return wide.select(F.col("id").alias(id_col), hexed.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
