"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.common import SPACES, ascii_lower, let, text_or_empty
from fathom.runtime import materialize

#: Frequent lines, of two longs each, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashed(lines: Column, min_chars: int) -> Column:
    """(h, g, i, first) of each line that counts: a 128-bit hash of its key, its place, and if it is
    the first of its key in the document."""

    def mark(held: Column) -> Column:
        def first(x: Column, n: Column) -> Column:
            before = F.get(held, n - 1)
            return F.struct(x["h"].alias("h"), x["g"].alias("g"), x["i"].alias("i"), ((n == 0) | (before["h"] != x["h"]) | (before["g"] != x["g"])).alias("first"))

        return F.transform(held, first)

    keys = F.filter(F.transform(lines, lambda x, i: F.struct(_key(x).alias("k"), i.alias("i"))), lambda x: F.length(x["k"]) >= min_chars)
    return let(F.sort_array(F.transform(keys, lambda x: F.struct(F.xxhash64(x["k"]).alias("h"), F.xxhash64(F.lit(1), x["k"]).alias("g"), x["i"].alias("i")))), mark)


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold.

    Lines are split at ``\\n``; a line's key is the line without white space at both ends, A-Z in
    lower case. Keys of fewer than ``min_chars`` code points never count. The rows of ``docs`` come
    back with ``text`` reassembled from the lines that stay, in their order, and with ``n_lines``
    and ``n_dropped`` (long). Input columns of those two names, in any case, give way to them.

    Lines are exploded as 128-bit hashes of their keys with their places. Documents per hash are
    counted with partial sums, so a line that a third of all rows hold is no single task's burden.
    The frequent hashes, a small table of the shared folder, are broadcast if there are at most
    BROADCAST of them, else joined by a shuffle. What comes back to a document are the places to
    drop, and work per text follows its length.

    Null and empty texts have one empty line and stay (null becomes ""). Rows are documents: a
    repeated row counts again. A null id is a value like any other. An empty table gives an empty
    table.
    """
    t = text_or_empty(text)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), t.alias("text"), F.xxhash64(t).alias("hash"))
    lines = F.split("text", "\n", -1)
    each = held.select("id", "hash", F.explode(_hashed(lines, min_chars)).alias("x")).select("id", "hash", "x.*")
    often = materialize(each.groupBy("h", "g").agg(F.sum(F.col("first").cast("long")).alias("n")).where(F.col("n") >= min_docs).select("h", "g"), "lines")
    few = often.limit(BROADCAST + 1).count() <= BROADCAST
    gone = each.join(F.broadcast(often) if few else often, ["h", "g"], "left_semi")
    gone = gone.groupBy("id", "hash").agg(F.collect_set("i").alias("gone")).select(F.col("id").alias("of"), F.col("hash").alias("at"), "gone")
    wide = held.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("at")), "left")

    def keep(found: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("gone"))
        whole = F.col("gone").isNull()
        return F.struct(F.size(found).cast("long").alias("n"), F.when(whole, F.lit(0)).otherwise(F.size("gone")).cast("long").alias("dropped"), F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(found, i)), "\n")).alias("text"))

    out = wide.select("row", let(lines, keep).alias("made"))
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("made.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in rest], F.col("made.n").alias("n_lines"), F.col("made.dropped").alias("n_dropped"))
