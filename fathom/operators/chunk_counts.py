"""Figures of the chunks of many settings, counted without making the chunks.

A batch of texts is one array. All its runs of small pieces are walked at once: a step takes each to its
next chunk, so the number of steps is that of the chunks of the longest run."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.functions.text import CLOSING
from fathom.operators.chunkers import STATEFUL, by_chapter
from fathom.runtime import dealt_out, given_back

COUNTS = ("chunk_count", "cut", "augmented", "flagged")
#: Characters of the texts that are looked at together, and of those that are put in order before; a text at least.
BATCH_CHARS, ORDER_CHARS = 1 << 20, 1 << 23
#: Kinds of characters; what Python takes for white space is from SPACE on.
CLOSER, SPACE, BLANK, LINE = 1, 2, 3, 4
_KINDS = np.zeros(0x3002, np.uint8)  # no closer and no white space lies beyond
_KINDS[[ord(c) for c in CLOSING]] = CLOSER
_KINDS[[c for c in range(len(_KINDS)) if chr(c).isspace()]] = SPACE
_KINDS[[ord(" "), ord("\n")]] = BLANK, LINE


class Pieces:
    """Texts, none empty, in a row, with the places where a recursive split may cut them."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.text = texts, "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
        self.starts = np.cumsum([0, *map(len, texts)])

        def marked(places: np.ndarray) -> np.ndarray:
            mark = np.append(places, True)
            mark[self.starts] = True
            return mark

        double = [s + m.start() for s, t in zip(self.starts.tolist(), texts, strict=False) if "\n\n" in t for m in re.finditer("\n\n", t)] if "\n\n" in self.text else []
        words = marked(self.kinds >= BLANK)
        #: Starts of the pieces at each separator but the last, and the end of all.
        self.bounds = [np.union1d(self.starts, double).astype(np.int64), np.flatnonzero(marked(self.kinds == LINE)), np.flatnonzero(words)]
        self.lengths = [np.diff(b) for b in self.bounds]
        #: Words that start at a place or before.
        self.rank = np.cumsum(words, dtype=np.int32)
        at = self.bounds[-1]
        self.own = np.where(self.kinds[at[1:] - 1] >= SPACE, -1, at[1:] - 1)
        for k in np.flatnonzero((self.own < 0) & (self.lengths[-1] > 1)).tolist():
            if piece := self.text[at[k] : at[k + 1]].rstrip():
                self.own[k] = at[k] + len(piece) - 1
        #: Where the last character up to the end of a word lies that isn't white space, and whether it closes a sentence.
        self.last = np.maximum.accumulate(self.own)
        self.closes = self.kinds[self.last] == CLOSER

    def recursive(self, size: int, overlap: int) -> np.ndarray:
        """How many pieces ``split_recursive`` makes, and how many of them close no sentence."""
        if overlap > size:
            raise ValueError("overlap exceeds size")
        size, rank, total = max(size, 1), self.rank, len(self.kinds)
        made = closed = 0

        def windows(level: int, i: np.ndarray, end: np.ndarray) -> None:
            """Small pieces from each i on, up to its end, gathered to overlapping chunks."""
            nonlocal made, closed
            at, words = self.bounds[level], level == 2
            while len(i):
                start = at[i]
                most = np.minimum(start + size, total)
                to = np.minimum((rank[most] if words else np.searchsorted(at, most, "right")) - 1, end)
                stop = at[to]
                word = (to if words else rank[stop] - 1) - 1
                held = self.last[word] >= start
                made += np.count_nonzero(held)
                closed += np.count_nonzero(held & self.closes[word])
                on = to < end
                to, end, stop = to[on], end[on], stop[on]
                least = np.minimum(np.maximum(stop - overlap, at[to + 1] - size), stop)
                i = rank[least - 1] if words else np.searchsorted(at, least)

        def characters(start: np.ndarray, end: np.ndarray) -> None:
            nonlocal made, closed
            step = size - min(max(overlap, 0), size - 1)
            n = np.maximum(-(-(end - start - size) // step), 0) + 1
            start = np.repeat(start, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            stop = np.minimum(start + size, np.repeat(end, n))
            kinds = self.kinds[stop - 1]
            made += np.count_nonzero(kinds < SPACE)
            closed += np.count_nonzero(kinds == CLOSER)
            for k in np.flatnonzero(kinds >= SPACE).tolist():
                piece = self.text[start[k] : stop[k]].rstrip()
                made += bool(piece)
                closed += bool(piece) and piece[-1] in CLOSING

        def split(level: int, start: np.ndarray, end: np.ndarray) -> None:
            if level == len(self.bounds):
                return characters(start, end)
            at = self.bounds[level]
            first, after = np.searchsorted(at, start), np.searchsorted(at, end)
            long = np.flatnonzero(self.lengths[level] >= size)
            of = np.searchsorted(first, long, "right") - 1
            long = long[(of >= 0) & (long < after[of])]
            i, end = np.sort(np.concatenate([first, long + 1])), np.sort(np.concatenate([after, long]))
            windows(level, i[i < end], end[i < end])
            if len(long):
                split(level + 1, at[long], at[long + 1])

        split(0, self.starts[:-1], self.starts[1:])
        return np.array([made, made - closed])

    def tokens(self, size: int, overlap: int) -> np.ndarray:
        """How many windows ``token_windows`` makes, and how many of them close no sentence."""
        ends = self.own[self.own >= 0]
        after = np.searchsorted(ends, self.starts)
        base, n, step = after[:-1], np.diff(after), max(1, size - overlap)
        # a word may hold several tokens if there is other white space, and to Python four more characters are such
        odd = np.unique(np.searchsorted(self.starts, np.flatnonzero(self.kinds == SPACE), "right") - 1)
        n[odd] = 0
        base, n = base[n > 0], n[n > 0]
        windows = np.minimum(-(-np.maximum(n - size, 0) // step) + 1, -(-n // step))
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        last = np.repeat(base, windows) + np.minimum(nth * step + size, np.repeat(n, windows)) - 1
        made, cut = len(last), np.count_nonzero(self.kinds[ends[last]] != CLOSER)
        for k in odd.tolist():
            words = [w for w in _WHITE.split(self.texts[k]) if w]
            found = [words[min(i + size, len(words)) - 1][-1] for i in range(0, min(-(-max(len(words) - size, 0) // step) * step + 1, len(words)), step)]
            made, cut = made + len(found), cut + sum(c not in CLOSING for c in found)
        return np.array([made, cut])


#: White space as ``tokens`` has it.
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _batches(texts: list[str]) -> Iterator[Pieces]:
    """Texts whose longest lines are alike lie together, as their runs end after about as many steps."""
    held, chars = [], 0
    for t in sorted(texts, key=lambda t: max(map(len, t.split("\n")))):
        held.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield Pieces(held)
            held, chars = [], 0
    if held:
        yield Pieces(held)


def _one_by_one(text: str, mode: str, size: int, overlap: int) -> np.ndarray:
    rows = [r if isinstance(r, dict) else {"text": r} for r in STATEFUL[mode](text, size, overlap)]
    flags = [r["boundary_truncated"] for r in rows if "boundary_truncated" in r]
    ends = [] if flags else [r["text"].strip(" \t\n\x0b\f\r") for r in rows]  # as ``looks_truncated`` does
    cut = sum(flags) + sum((c[:-1] if c[-1] in "\x85\u2028\u2029" else c)[-1:] not in [*CLOSING] for c in ends)
    return np.array([len(rows), cut, sum(r.get("context_augmented", False) for r in rows), len(flags)])


def count_chunks(texts: Sequence[str | None], settings: Sequence[tuple[str, int]], overlap: int, small: int = 128) -> np.ndarray:
    """A row for each setting (mode, size): how many chunks ``chunk_texts`` makes, how many of them are cut,
    open with context, and say themselves whether they are cut."""
    texts = [t for t in texts if t]
    # whether context fits in may depend on the chunk if it has next to no room
    slow = {x for x in settings if x[0] not in ("token", "fixed", "structure_text") or (x[0] == "structure_text" and x[1] <= small and int(1.5 * x[1]) - x[1] - len("[CTX] \n") <= 0)}
    wanted = {m: {s for x, s in settings if x == m and (x, s) not in slow} for m in ("token", "fixed", "structure_text")}
    chapters = [(t, [ps for _, ps in by_chapter(t)]) for t in texts] if wanted["structure_text"] else [(t, []) for t in texts]
    # texts that are a paragraph, other texts, their paragraphs
    groups = [[t for t, c in chapters if c == [[t]]], [t for t, c in chapters if c != [[t]]], [p for t, c in chapters if c != [[t]] for ps in c for p in ps]]
    modes = [("token", "fixed", "structure_text"), ("token", "fixed"), ("structure_text",)]
    found: dict[tuple[str, int], np.ndarray] = {x: np.zeros(2, np.int64) for x in settings}
    for group, at in zip(groups, modes, strict=True):
        for pieces in _batches(group):
            for size in set().union(*(wanted[m] for m in at if m != "token")):
                n = pieces.recursive(size, overlap)
                for m in at:
                    if m != "token" and size in wanted[m]:
                        found[m, size] += n
            for size in wanted["token"] if "token" in at else ():
                found["token", size] += pieces.tokens(size, overlap)
    paragraphs, firsts = sum(len(ps) for _, c in chapters for ps in c), sum(bool(ps) for _, c in chapters for ps in c)
    out = []
    for x in settings:
        n, cut = found[x]
        if x in slow:
            out.append(sum((_one_by_one(t, *x, overlap) for t in texts), np.zeros(4, np.int64)))
        elif x[0] == "structure_text":  # all but the last piece of a paragraph are cut; all but the first of a chapter have context
            out.append(np.array([n, n - paragraphs, n - firsts if x[1] <= small else 0, n]))
        else:
            out.append(np.array([n, cut, 0, 0]))
    return np.array(out)


def chunk_counts(docs: DataFrame, settings: Sequence[tuple[str, int]], overlap: int, text: str = "text") -> DataFrame:
    """(setting, chunk_count, cut, augmented, flagged): figures of the chunks of all settings, a row for
    each part of the table and setting. One pass over the texts; chunks never leave a worker."""
    settings = list(dict.fromkeys(settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(settings), len(COUNTS)), np.int64)
        for batch in given_back(batches):
            texts, chars = [], 0
            for t in batch.column(0):
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= ORDER_CHARS:
                    sums += count_chunks(texts, settings, overlap)
                    texts, chars = [], 0
            sums += count_chunks(texts, settings, overlap)
            del batch, texts
        columns = [pa.array([f"{m}_{s}" for m, s in settings]), *map(pa.array, sums.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["setting", *COUNTS])

    return dealt_out(docs.select(text)).mapInArrow(run, "setting string, " + ", ".join(f"{c} long" for c in COUNTS))
