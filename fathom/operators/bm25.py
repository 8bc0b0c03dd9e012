"""BM25 over a document-partitioned index: segments that rank their own documents, and statistics of terms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathom.functions.text import tokens
from fathom.runtime import dealt_out, given_back, materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents in a segment; a long array of one segment is never larger than their words.
SEGMENT_DOCS = 512
SEGMENT = ("seg", "grp", "n", "words", "docs", "dls", "terms", "dfs", "ats", "tfs")
#: Rows in a row group of segments. Spark reads the arrays of a whole row group at once, up to 4,096 rows of
#: megabytes each, so the heap of a task holds what a row group has.
SEGMENT_FILES = {"parquet.block.row.count.limit": 8}
#: Terms of queries, and bytes in them, that go to every task at once; more queries go in blocks.
ASKED, ASKED_BYTES = 200_000, 1 << 23
#: Digits of a score that count; orders of summation differ in less than that.
DIGITS = 6


@dataclass
class SparseIndex:
    """segments (seg, grp, n, words, docs, dls, terms, dfs, ats, tfs): each holds up to SEGMENT_DOCS documents in
    order with their lengths, and by term the places of those that hold it, with counts.

    Derived from them: terms (grp, term, df, idf), totals (grp, n, avgdl), docs (grp, doc). Without
    groups there is one, null. ``counts`` (grp, term, df) is what the statistics are made of.
    """

    segments: DataFrame
    counts: DataFrame
    lower: bool = False
    grouped: bool = False

    @cached_property
    def stats(self) -> dict[str | None, tuple[int, float, float | None]]:
        """Documents, their mean length and the mean idf before its floor, by group: found once."""
        sums = self.segments.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
        sizes = {r["grp"]: (r["n"], r["words"] / r["n"]) for r in sums}
        mean = {r["grp"]: r["mean"] for r in self._raw({g: (n, None) for g, (n, _) in sizes.items()}).groupBy("grp").agg(F.avg("raw").alias("mean")).collect()}
        return {g: (n, avgdl, mean.get(g)) for g, (n, avgdl) in sizes.items()}

    def _of_groups(self, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
        """A row a group, as an Arrow table: one of Python rows would start a second set of Python workers in
        every executor, beside those that made the segments and keep their memory."""
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
        return self.counts.sparkSession.createDataFrame(pa.table(made, names=list(kinds)))

    def _raw(self, known: dict[str | None, tuple[int, float | None]]) -> DataFrame:
        """(grp, term, df, raw, mean): idf before its floor, and the mean of its group."""
        rows = self._of_groups([(g, n, m) for g, (n, m) in known.items()], of=pa.string(), total=pa.int64(), mean=pa.float64())
        held = self.counts.join(F.broadcast(rows), F.col("grp").eqNullSafe(F.col("of")))  # a row for each group
        return held.select("grp", "term", "df", (F.log(F.col("total") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"), "mean")

    @property
    def totals(self) -> DataFrame:
        return self._of_groups([(g, n, avgdl) for g, (n, avgdl, _) in self.stats.items()], grp=pa.string(), n=pa.int64(), avgdl=pa.float64())

    @property
    def terms(self) -> DataFrame:
        """idf is ln(N - df + 0.5) - ln(df + 0.5); where that is below 0 (a term in more than half of
        the documents) it is a quarter of the mean over all terms of the group."""
        idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
        return self._raw({g: (n, mean) for g, (n, _, mean) in self.stats.items()}).select("grp", "term", "df", idf.alias("idf"))

    @property
    def docs(self) -> DataFrame:
        return self.segments.select("grp", F.explode("docs").alias("doc"))


def _order(doc: object) -> tuple:
    """A key that orders document ids as Spark does: null first, structs field by field."""
    if doc is None:
        return (0,)
    return (1, tuple(_order(v) for v in doc.values())) if isinstance(doc, dict) else (1, doc)


def _row(grp: pa.Array, docs: pa.Array, dls: np.ndarray, terms: pa.Array, dfs: np.ndarray, ats: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
    """One segment, with a new name."""

    def one(values: pa.Array | np.ndarray) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    sums = [pa.array([len(dls)], pa.int64()), pa.array([int(dls.sum())], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), grp, *sums, *map(one, (docs, dls, terms, dfs, ats, tfs))], names=list(SEGMENT))


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, doc, words) to segments."""
    for batch in given_back(batches):
        grp, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        held: dict[object, list[int]] = {}
        for i, g in enumerate(grp):
            held.setdefault(g, []).append(i)
        lists = batch.column(2)
        for rows in held.values():
            rows.sort(key=lambda i: _order(doc[i]))
            for at in range(0, len(rows), SEGMENT_DOCS):
                part = pa.array(rows[at : at + SEGMENT_DOCS], pa.int64())
                own = lists.take(part)
                sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False)
                words = own.flatten().dictionary_encode()
                order = pc.array_sort_indices(words.dictionary)
                place = np.empty(len(order), dtype=np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                codes = place[words.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
                pairs, tf = np.unique(codes, return_counts=True)
                df = np.bincount(pairs // max(1, len(sizes)), minlength=len(order))
                yield _row(batch.column(0).take(part.slice(0, 1)), batch.column(1).take(part), sizes, words.dictionary.take(order), df, pairs % max(1, len(sizes)), tf)


def segments_of(corpus: DataFrame, doc: str = "doc_id", text: str = "text", lower: bool = False, by: str | None = None) -> DataFrame:
    """The segments of a corpus, where its rows lie: no text and no posting is shuffled."""
    grp = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = dealt_out(corpus.select(grp.alias("grp"), F.col(doc).alias("doc"), F.col(text).alias("body")))
    rows = rows.select("grp", "doc", tokens(F.coalesce("body", F.lit("")), lower).alias("words"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_segment, f"seg string, grp string, n long, words long, docs array<{kind}>, dls array<int>, terms array<string>, dfs array<int>, ats array<int>, tfs array<int>")


def counted(segments: DataFrame) -> DataFrame:
    each = segments.select("grp", F.inline(F.arrays_zip("terms", "dfs"))).toDF("grp", "term", "df")
    return each.groupBy("grp", "term").agg(F.sum("df").cast("long").alias("df"))


def build_index(corpus: DataFrame, doc: str = "doc_id", text: str = "text", lower: bool = False, by: str | None = None) -> SparseIndex:
    """Index of a corpus, read once; two tables of the shared folder, segments and counts of terms.

    With ``by``, documents of each value of that column are a corpus of their own, with its own
    statistics, in the same tables and passes. A row is a document; null texts have no words.
    """
    segments = materialize(segments_of(corpus, doc, text, lower, by), "segments", small=True, **SEGMENT_FILES)
    return SparseIndex(segments, materialize(counted(segments), "term-counts"), lower, by is not None)


def save_index(index: SparseIndex, folder: str) -> None:
    """Write an index, to be opened by other sessions."""
    index.segments.write.mode("overwrite").options(**SEGMENT_FILES).parquet(f"{folder}/segments")
    index.counts.write.mode("overwrite").parquet(f"{folder}/counts")


def open_index(spark: SparkSession, folder: str, lower: bool = False, grouped: bool = False) -> SparseIndex:
    return SparseIndex(spark.read.parquet(f"{folder}/segments"), spark.read.parquet(f"{folder}/counts"), lower, grouped)


def extend_index(index: SparseIndex, corpus: DataFrame, doc: str = "doc_id", text: str = "text", by: str | None = None) -> SparseIndex:
    """The index with more documents: only they are read; counts of terms add up."""
    more = materialize(segments_of(corpus, doc, text, index.lower, by), "segments", small=True, **SEGMENT_FILES)
    counts = index.counts.unionByName(counted(more)).groupBy("grp", "term").agg(F.sum("df").alias("df"))
    return SparseIndex(index.segments.select(*SEGMENT).unionByName(more), materialize(counts, "term-counts"), index.lower, index.grouped)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments without the documents whose places stand in a last column, one at a time."""
    for batch in given_back(batches):
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            dls, dfs, ats, tfs, gone = [columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("dls", "dfs", "ats", "tfs", "gone")]
            stays = np.ones(len(dls), dtype=bool)
            stays[gone] = False
            if not stays.any():
                continue
            held = stays[ats]
            df = np.bincount(np.repeat(np.arange(len(dfs)), dfs)[held], minlength=len(dfs))
            kept = np.flatnonzero(df)
            new, stay = np.cumsum(stays) - 1, pa.array(np.flatnonzero(stays))
            yield _row(columns["grp"].slice(i, 1), columns["docs"][i].values.take(stay), dls[stays], columns["terms"][i].values.take(pa.array(kept)), df[kept], new[ats[held]], tfs[held])


def remove_documents(index: SparseIndex, gone: DataFrame) -> SparseIndex:
    """The index without the documents ``gone`` (doc): segments that hold one are written anew, the
    others stay where they are, and counts of terms are taken off. Where segments and ``gone`` have a
    ``batch``, only documents of earlier batches go."""
    lost = gone.select(F.col("doc").alias("__doc"), *[F.col("batch").alias("__batch")] * ("batch" in gone.columns)).distinct()
    earlier = F.col("batch") < F.col("__batch") if "batch" in gone.columns and "batch" in index.segments.columns else F.lit(True)
    of = index.segments.select("seg", *[c for c in ("batch",) if c in index.segments.columns], F.posexplode("docs").alias("at", "doc"))
    places = of.join(lost, F.col("doc").eqNullSafe(F.col("__doc")) & earlier, "left_semi").groupBy(F.col("seg").alias("__seg")).agg(F.collect_list("at").alias("gone"))
    places = materialize(places, "places")
    hit = index.segments.join(places, F.col("seg") == F.col("__seg")).select(*SEGMENT, "gone")
    kinds = index.segments.select(*SEGMENT).schema
    thinned = materialize(hit.mapInArrow(_thin, kinds), "segments", small=True, **SEGMENT_FILES)
    rest = index.segments.join(places, F.col("seg") == F.col("__seg"), "left_anti").select(*SEGMENT)
    less = counted(hit).select("grp", "term", (-F.col("df")).alias("df"))
    counts = index.counts.unionByName(less).unionByName(counted(thinned)).groupBy("grp", "term").agg(F.sum("df").alias("df")).where("df > 0")
    return SparseIndex(rest.unionByName(thinned), materialize(counts, "term-counts"), index.lower, index.grouped)


class _Asked:
    """The queries of a block, as one group of the index sees them: terms and weights, by query."""

    def __init__(self, avgdl: float, weighed: list[list[tuple[str, float]]]):
        vocabulary: dict[str, int] = {}
        for terms in weighed:
            for t, _ in terms:
                vocabulary.setdefault(t, len(vocabulary))
        self.avgdl, self.vocabulary = avgdl, list(vocabulary)
        self.ends = np.cumsum([0, *map(len, weighed)])
        self.term = np.array([vocabulary[t] for terms in weighed for t, _ in terms], dtype=np.int64)
        self.weight = np.array([w for terms in weighed for _, w in terms], dtype=np.float64)
        self.query = np.repeat(np.arange(len(weighed)), np.diff(self.ends))


class _Segment:
    """The postings of one segment that a block of queries asks for, and what each term adds at most."""

    def __init__(self, asked: _Asked, dls: np.ndarray, terms: pa.Array, dfs: np.ndarray, ats: np.ndarray, tfs: np.ndarray):
        self.asked, self.n = asked, len(dls)
        where = pc.index_in(pa.array(asked.vocabulary, pa.string()), value_set=terms)
        held = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
        place = where.drop_null().to_numpy().astype(np.int64)
        self.row = np.full(len(asked.vocabulary), -1, dtype=np.int64)
        self.row[held] = np.arange(len(held))
        size = dfs[place].astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(size)))
        flat = np.arange(self.ends[-1]) + np.repeat((np.cumsum(dfs) - dfs)[place] - self.ends[:-1], size)
        self.at, tf = ats[flat], tfs[flat].astype(np.float64)
        self.gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls[self.at] / asked.avgdl)) if len(flat) else tf
        self.most = np.maximum.reduceat(self.gain, self.ends[:-1]) if len(held) else np.zeros(0)

    def bounds(self, queries: int) -> np.ndarray:
        """No document of the segment scores more; one without a query's terms scores 0."""
        row = self.row[self.asked.term]
        held = row >= 0
        adds = np.maximum(0, self.asked.weight[held] * self.most[row[held]])
        return np.bincount(self.asked.query[held], weights=adds, minlength=queries)

    def scores(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether it holds a query term) of every document."""
        part = slice(self.asked.ends[query], self.asked.ends[query + 1])
        row = self.row[self.asked.term[part]]
        held = row >= 0
        row, weight = row[held], self.asked.weight[part][held]
        first, size = self.ends[row], self.ends[row + 1] - self.ends[row]
        flat = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        at = self.at[flat]
        score = np.bincount(at, weights=self.gain[flat] * np.repeat(weight, size), minlength=self.n)
        return np.round(score, DIGITS) + 0.0, np.bincount(at, minlength=self.n) > 0


def _blocks(index: SparseIndex, queries: DataFrame, qid: str, query: str) -> Iterator[tuple[list, dict[str | None, _Asked]]]:
    """Queries in blocks of a bounded size: their ids, and by group of the index what they ask for."""
    split = queries.select(F.col(qid).alias("qid"), F.explode_outer(tokens(F.coalesce(F.col(query), F.lit("")), index.lower)).alias("term"))
    asked = split.groupBy("qid", "term").agg(F.count("*").alias("times"))
    known = index.terms.join(asked.select("term").distinct(), "term", "left_semi")
    weighed = asked.join(known, "term", "left").groupBy("qid").agg(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("grp", "term", (F.col("times") * F.col("idf")).alias("w")))).alias("terms"))
    rows, n, size = [], 0, 0

    def block() -> tuple[list, dict[str | None, _Asked]]:
        each = {g: _Asked(avgdl, [[(t, w) for of, t, w in r["terms"] if of == g] for r in rows]) for g, (_, avgdl, _) in index.stats.items()}
        return [r["qid"] for r in rows], each

    for r in weighed.toLocalIterator():
        rows.append(r)
        n, size = n + len(r["terms"]), size + sum(len(t["term"]) for t in r["terms"])
        if n >= ASKED or size >= ASKED_BYTES:
            yield block()
            rows, n, size = [], 0, 0
    if rows:
        yield block()


def _searched(index: SparseIndex, queries: DataFrame, qid: str, query: str, search) -> DataFrame:
    """(grp, qid, doc, score): what ``search`` finds for every block of queries, over all segments."""
    spark, kind = index.segments.sparkSession, index.segments.schema["docs"].dataType.elementType
    of = queries.select(F.col(qid).alias("qid")).schema["qid"].dataType
    schema = f"grp string, qid {of.simpleString()}, doc {kind.simpleString()}, score double"
    found = spark.createDataFrame([], schema)
    for n, (ids, asked) in enumerate(_blocks(index, queries, qid, query)):
        held = spark.sparkContext.broadcast((ids, asked))
        part = index.segments.mapInArrow(search(held), schema)
        found = part if n == 0 else found.unionByName(part)
    return found


def _opened(batches: Iterator[pa.RecordBatch], asked: dict[str | None, _Asked]) -> Iterator[tuple[str | None, pa.Array, _Segment]]:
    for batch in given_back(batches):
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            grp = columns["grp"][i].as_py()
            numbers = [columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("dls", "dfs", "ats", "tfs")]
            yield grp, columns["docs"][i].values, _Segment(asked[grp], numbers[0], columns["terms"][i].values, *numbers[1:])


def _rows(found: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds.field(i).type) for i in range(4)], schema=kinds)


def _kinds(index: SparseIndex, queries: DataFrame, qid: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    doc, of = index.segments.schema["docs"].dataType.elementType, queries.select(qid).schema[0].dataType
    return pa.schema([("grp", pa.string()), ("qid", to_arrow_type(of)), ("doc", to_arrow_type(doc)), ("score", pa.float64())])


def scores(index: SparseIndex, queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """(grp, qid, doc, score) of every document that holds a query term; a term twice in a query counts
    twice. Scores are rounded."""
    kinds = _kinds(index, queries, qid)

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            for grp, docs, segment in _opened(batches, asked):
                for q, name in enumerate(ids):
                    score, hit = segment.scores(q)
                    at = np.flatnonzero(hit)
                    if len(at):
                        yield _rows([(grp, name, d, s) for d, s in zip(docs.take(pa.array(at)).to_pylist(), score[at].tolist(), strict=True)], kinds)

        return run

    return _searched(index, queries, qid, query, search)


def top(index: SparseIndex, queries: DataFrame, k: int, qid: str = "qid", query: str = "query") -> DataFrame:
    """(grp, qid, doc, score, rank from 1): the best ``k`` documents of each query in each group of the
    index, ties by document. ``grp`` is left out if the index was built without groups.

    All documents have a rank, those without a query term with score 0, which is more than a score
    below 0. Queries go to the tasks in blocks of a bounded size; a task streams over its segments and
    keeps the best ``k`` of each query so far. A segment that can't hold a better one, by the most that
    its postings add for the query's terms, isn't scored. What is shuffled is tasks x queries x k
    rows, whatever the corpus. Scores are rounded before they rank, so that the order of summation
    doesn't break ties.
    """
    kinds = _kinds(index, queries, qid)

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            best: dict[str | None, list[list]] = {}
            for grp, docs, segment in _opened(batches, asked):
                lists = best.setdefault(grp, [[] for _ in ids])
                bounds = np.round(segment.bounds(len(ids)), DIGITS) + 10.0**-DIGITS
                first, names = _order(docs[0].as_py()), None
                for q, mine in enumerate(lists):
                    full = len(mine) >= k
                    if full and (-bounds[q], first) > mine[-1][:2]:
                        continue
                    score, _ = segment.scores(q)
                    near = np.flatnonzero(score >= -mine[-1][0]) if full else np.arange(len(score))
                    near = near[np.argsort(-score[near], kind="stable")[:k]]  # documents of a segment are in order
                    if len(near):
                        names = names or [(_order(d), d) for d in docs.to_pylist()]
                        mine += [(-s, *names[i]) for s, i in zip(score[near].tolist(), near.tolist(), strict=True)]
                        mine.sort(key=lambda x: x[:2])
                        del mine[k:]
            for grp, lists in best.items():
                yield _rows([(grp, name, d, -s) for name, mine in zip(ids, lists, strict=True) for s, _, d in mine], kinds)

        return run

    found = _searched(index, queries, qid, query, search)
    order = Window.partitionBy("grp", "qid").orderBy(F.desc("score"), "doc")
    ranked = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked", small=True)
    return ranked if index.grouped else ranked.drop("grp")
