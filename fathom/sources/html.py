"""Records from HTML pages: a heading's name and the paragraphs that follow it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Sections(HTMLParser):
    """Text of headings and of the paragraphs after them; scripts and styles don't count."""

    def __init__(self, name: str, ends: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.name, self.ends = name, ends
        self.skipped, self.inside = 0, None
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag in self.ends or tag == self.name:
            self.open = tag == self.name
            self.inside = "name" if self.open else None
            if self.open:
                self.found.append(["", ""])
        elif tag == "p":
            self.inside = "text" if self.open else None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif tag in (self.name, "p"):
            self.inside = None

    def handle_data(self, data: str) -> None:
        if self.inside and not self.skipped:
            at = 0 if self.inside == "name" else 1
            self.found[-1][at] += (" " if at and self.found[-1][at] else "") + data.strip()


#: Fixed value: an ampersand that begins no reference with a semicolon at its end.
_UNENDED = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")


def sections(pages: DataFrame, id_col: str = "page_id", html: str = "html", name: str = "h3", ends: tuple[str, ...] = ("h2", "h3"), ended: bool = False) -> DataFrame:
    """(id, seq, name, description): sections with a name of two characters or more and some text.

    References of old that lack their semicolon (``&amp`` at the end of a cut title) count, as in
    browsers; with ``ended`` they are text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seqs, names, texts = [], [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                parser = _Sections(name, ends)
                parser.feed(_UNENDED.sub("&amp;", page or "") if ended else page or "")
                parser.close()
                rows = [(a.strip(), b.strip()) for a, b in parser.found]
                for n, (a, b) in enumerate(r for r in rows if len(r[0]) > 1 and r[1]):
                    keys.append(i)
                    seqs.append(n)
                    names.append(a)
                    texts.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(seqs, pa.int32()), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=[id_col, "seq", "name", "description"])

    return pages.select(id_col, html).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, seq int, name string, description string")
