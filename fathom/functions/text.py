"""Text functions over columns: tokens, sentences, cleaning, keys, formats."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

#: What a normalised answer keeps.
KEPT = r"[^a-z0-9가-힣\s]"
#: What closes a sentence at its end.
CLOSING = ".?!\"'”’)]}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column, lower: bool = False) -> Column:
    """Runs without (Unicode) white space; two spaces make no empty token."""
    return F.filter(F.split(F.lower(text) if lower else text, r"(?U)\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space, trimmed, none empty."""
    pieces = F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tail(text: Column, n: int = 160) -> Column:
    """The last ``n`` characters once white space is squeezed."""
    return F.right(squeeze(text), F.lit(n))


def head(text: Column, n: int = 220) -> Column:
    return F.left(squeeze(text), F.lit(n))


def with_context(context: Column, content: Column, size: int) -> Column:
    """``content`` behind a line of context, all within one and a half times ``size`` characters."""
    cap = int(1.5 * size)
    last = tail(context, max(90, size // 2))
    room = F.lit(cap) - F.length(content) - len("[CTX] \n")
    fitted = F.right(last, F.greatest(room, F.lit(0)))
    return F.when((F.coalesce(F.length(last), F.lit(0)) == 0) | (room <= 0), content).otherwise(F.concat(F.lit("[CTX] "), fitted, F.lit("\n"), content))


def normalise_text(text: str) -> str:
    """Compatibility forms apart, lower case, letters and digits only, single spaces."""
    return re.sub(r"\s+", " ", re.sub(KEPT, " ", unicodedata.normalize("NFKD", text or "").lower())).strip()


@F.pandas_udf(StringType())
def _normalise(text: pd.Series) -> pd.Series:
    return text.map(normalise_text, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _normalise_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: [None if t is None else normalise_text(t) for t in a], na_action="ignore")


def _ascii_normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalise_each(texts: Column) -> Column:
    """``normalise_text`` of each item of an array; arrays of pure ASCII never leave the JVM."""
    plain = F.forall(texts, lambda t: F.coalesce(F.octet_length(t) == F.length(t), F.lit(True)))
    return F.when(plain, F.transform(texts, _ascii_normalised)).otherwise(_normalise_each(F.when(~plain, texts)))


def normalise(text: Column) -> Column:
    """``normalise_text`` as a column; pure ASCII never leaves the JVM."""
    return F.when(F.octet_length(text) == F.length(text), _ascii_normalised(text)).otherwise(_normalise(F.when(F.octet_length(text) != F.length(text), text)))


def holds(haystack: Column, needle: Column) -> Column:
    """Whether the normalised haystack contains the normalised needle. An empty needle isn't held;
    one that only normalises to nothing is."""
    raw = F.coalesce(needle, F.lit("")) == ""
    return F.when(raw, False).otherwise(F.contains(normalise(F.coalesce(haystack, F.lit(""))), normalise(needle)))


def preview(text: Column, n: int = 150, flat: bool = True) -> Column:
    return F.left(F.translate(text, "\n", " ") if flat else text, F.lit(n))


def content_id(text: Column) -> Column:
    """The same for equal texts, on every run."""
    return F.sha2(text, 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def parse_list(text: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def first_given(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def clean_book_text(text: Column) -> Column:
    """One kind of line end, no trailing white space, no page marker lines."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?i)Page\s*\|\s*\d+")), "\n")


def is_chapter_title(line: Column) -> Column:
    shout = (F.length(line) <= 80) & (F.upper(line) == line) & line.rlike("[A-Z]")
    return F.trim(line).rlike(r"^(CHAPTER|Chapter)\b") | shout


def looks_truncated(text: Column) -> Column:
    """Not blank, and the last character closes no sentence."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (stripped != "") & ~stripped.rlike(f"[{re.escape(CLOSING)}]$")


def starts_orphaned(code: Column) -> Column:
    """The first line that isn't blank is indented and opens no definition, decorator, string or comment."""
    first = F.get(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.coalesce(first.rlike("^[ \t]") & ~F.ltrim(first).rlike("^(def |class |@|\"\"\"|'''|#)"), F.lit(False))


def normalise_setting(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^text_e[12]_", ""), "_q30$", "")


def setting_size(setting: Column) -> Column:
    return F.coalesce(F.element_at(F.split(setting, "_"), -1).try_cast("int"), F.lit(-1))


def bar(value: Column, width: int = 24) -> Column:
    """A bar of ``width`` cells, halves to even."""
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.bround(value * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
