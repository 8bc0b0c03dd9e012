"""Figures of a grid of chunkings, which are counted without the chunks."""

import random

import pytest

from fathom import queries as Q
from fathom.functions.text import CLOSING
from fathom.operators import chunk_counts
from fathom.operators.chunkers import split_recursive
from fathom.plans import experiments

MARKS = ("\n\n", "\n", " ", "")
#: White space of both kinds, ends of sentences, long words, headings, blank paragraphs.
PARTS = ["a", "bc", "defgh", "x" * 9, "x" * 70, " ", " ", "   ", "\n", "\n\n", "\n \n", " \n", ".", "”", ") ", "\x1c", " ", "\x85", "é😀", "\nCHAPTER 1 x\n"]


def plain(text, size, overlap, marks=MARKS):
    """Piece by piece."""
    at = next(i for i, s in enumerate(marks) if not s or s in text)
    cut = text.split(marks[at]) if marks[at] else []
    pieces = [p for p in [cut[0], *(marks[at] + c for c in cut[1:])] if p] if cut else list(text)
    out, run = [], []

    def merge():
        window = []
        for p in run:
            if window and len("".join(window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        out.append("".join(window).strip())
        run.clear()

    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        merge()
        out += plain(p, size, overlap, marks[at + 1 :]) if marks[at] else [p.strip()]
    merge()
    return [c for c in out if c]


def odd_texts(n, most=60):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(n)]


def test_pieces_are_those_of_a_split_piece_by_piece():
    rng = random.Random(3)
    texts = [t for t in odd_texts(2000, 40) if t]
    for i in range(0, len(texts), 3):
        size = rng.randint(1, 40)
        overlap = rng.randint(-2, size)
        want = [c for t in texts[i : i + 3] for c in plain(t, size, overlap)]
        assert want == [c for t in texts[i : i + 3] for c in split_recursive(t, size, overlap)]
        assert [*chunk_counts.Pieces(texts[i : i + 3]).recursive(size, overlap)] == [len(want), sum(c[-1] not in CLOSING for c in want)], (texts[i : i + 3], size, overlap)


@pytest.mark.parametrize("overlap", [0, 7])
def test_grid_is_counted_as_its_chunks_are(spark, overlap):
    texts = [*odd_texts(400), *odd_texts(20, 2000), None, "", " \n ", "word " * 3000, "x" * 5000, "one line. " * 500 + "\n\n" + "two” " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    settings = [*experiments.E1, *experiments.E2, ("fixed", 9), ("token", 8), ("line", 30), ("structure_text", 9), ("structure_text", 17)]
    want = experiments.structure_report(experiments.chunk_grid(docs, settings, overlap)).collect()
    got = experiments.grid_report(docs, settings, overlap)
    assert sorted(got.collect()) == sorted(want) and len(want) == len(set(settings))
    several = chunk_counts.count_chunks(texts, settings, overlap)
    assert (several == sum(chunk_counts.count_chunks([t], settings, overlap) for t in texts)).all()
    assert experiments.grid_report(docs.where("text is null"), settings, overlap).count() == 0


def test_grid_reads_its_texts_once(spark):
    plan = Q.structure_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
