"""Places of pattern matches as arrays, with built-in functions only, in time that follows the text.

Expressions are written as text (``sqltext``): they have thousands of nodes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from fathom.llm.sqltext import S, Sql, let

#: Items that a fold adds to one array; a longer array is folded by blocks of so many, as appending copies.
BLOCK = 128
SPAN = "array<struct<a:int,b:int,m:string>>"
NEAR = "array<struct<a:int,b:int,m:string,l:string,l2:string,r:string>>"


def running(items: Sql, value: Callable[[Sql], Sql], kind: str, merge: Callable[[Sql, Sql], Sql]) -> Sql:
    """For each item, ``value`` merged over it and all before it. ``merge`` is associative, null being
    nothing; ``kind`` is the type of the values."""
    nothing, empty = S.lit(None).cast(kind), S.array().cast(f"array<{kind}>")

    def fold(part: Sql) -> Sql:
        def add(s: Sql, x: Sql) -> Sql:
            return let(merge(s["at"], value(x)), lambda v: S.struct(v.alias("at"), S.concat(s["out"], S.array(v)).alias("out")))

        return S.aggregate(part, S.struct(nothing.alias("at"), empty.alias("out")), add, lambda s: s["out"])

    def blocks(parts: Sql) -> Sql:
        def add(s: Sql, part: Sql) -> Sql:
            return S.struct(merge(s["at"], S.element_at(part, -1)).alias("at"), S.concat(s["out"], S.array(s["at"])).alias("out"))

        before = S.aggregate(parts, S.struct(nothing.alias("at"), empty.alias("out")), add, lambda s: s["out"])
        return S.flatten(S.zip_with(parts, before, lambda part, at: S.transform(part, lambda v: merge(at, v))))

    def run(found: Sql) -> Sql:
        cut = S.transform(S.sequence(0, S.floor((S.size(found) - 1) / BLOCK).cast("int")), lambda n: S.slice(found, n * BLOCK + 1, BLOCK))
        return S.when(S.size(found) <= BLOCK, fold(found), let(S.transform(cut, fold), blocks))

    return let(items, run)


def total(x: Sql, y: Sql) -> Sql:
    return S.coalesce(x + y, x, y)


def find_spans(text: Sql, pattern: str, hint: Sql | None = None, near: bool = False) -> Sql:
    """(a, b, m) of every leftmost non-overlapping match: start and end in code points, and text.

    The pieces between matches and the matches alternate, so running lengths are the places.
    ``hint``, if false, says that a cheaper test rules a match out. With ``near``, also l, the text
    from the match before, l2, the text from the match two before that, and r, the text up to the
    match after the next.
    """
    kind = NEAR if near else SPAN

    def lay(p: Sql) -> Sql:
        found, rest, ends = p["found"], p["rest"], p["ends"]

        def one(m: Sql, i: Sql) -> Sql:
            def piece(of: Sql, at: Sql) -> Sql:
                return S.when(at >= 0, S.coalesce(S.get(of, at), ""), "")

            b = S.get(ends, i)
            parts = [(b - S.length(m)).alias("a"), b.alias("b"), m.alias("m")]
            if near:
                back = S.concat(*[c for k in (2, 1) for c in (piece(rest, i - k), piece(found, i - k))], S.get(rest, i))
                on = S.concat(S.get(rest, i + 1), piece(found, i + 1), piece(rest, i + 2))
                parts += [S.get(rest, i).alias("l"), back.alias("l2"), on.alias("r")]
            return S.struct(*parts)

        return S.transform(found, one).cast(kind)

    def place(found: Sql) -> Sql:
        def measure(rest: Sql) -> Sql:
            steps = S.zip_with(S.slice(rest, 1, S.size(found)), found, lambda r, m: S.length(r) + S.length(m))
            return let(S.struct(found.alias("found"), rest.alias("rest"), running(steps, lambda x: x, "int", total).alias("ends")), lay)

        return S.when(S.size(found) == 0, S.array().cast(kind), let(S.split(text, pattern, -1), measure))

    spans = let(S.regexp_extract_all(text, pattern, 0), place)
    return spans if hint is None else S.when(hint, spans, S.array().cast(kind))


def by_place(kinds: dict[str, Sql]) -> Sql:
    """One array of (a, k, b, kind) over all kinds, by start, then in the order of ``kinds``."""

    def tag(k: int, kind: str, spans: Sql) -> Sql:
        return S.transform(spans, lambda x: S.struct(x["a"].alias("a"), S.lit(k).alias("k"), x["b"].alias("b"), S.lit(kind).alias("kind")))

    tagged = [tag(k, kind, spans) for k, (kind, spans) in enumerate(kinds.items())]
    return S.sort_array(reduce(lambda x, y: S.concat(x, y), tagged))


def written(placed: Sql) -> Sql:
    """kind:start:end, comma-joined."""
    return S.array_join(S.transform(placed, lambda x: S.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def count_kind(placed: Sql, k: int) -> Sql:
    """Spans of the kind with place ``k`` in the list."""
    return S.size(S.filter(placed, lambda x: x["k"] == k)).cast("long")


_PLACED = "struct<b:int,a:int,kind:string>"


def with_neighbours(placed: Sql, against: Callable[[Sql], Sql]) -> Sql:
    """(x, left, right) for each item of a sorted array of places: of the items that ``against``
    holds for, the one at or before it in the array that ends last, and the one after it that starts
    first. Each is (b, a, kind). One sweep forth and one back, so the join of places is linear."""

    def left(x: Sql) -> Sql:
        return S.when(against(x), S.struct(x["b"].alias("b"), x["a"].alias("a"), x["kind"].alias("kind")))

    def sweep(p: Sql) -> Sql:
        before, after = p["before"], p["after"]
        return S.transform(placed, lambda x, i: S.struct(x.alias("x"), S.when(i > 0, S.get(before, i - 1)).alias("left"), S.get(after, S.size(after) - 2 - i).alias("right")))

    before = running(placed, left, _PLACED, S.greatest)
    after = running(S.reverse(placed), left, _PLACED, lambda x, y: S.coalesce(y, x))
    return S.when(S.size(placed) == 0, S.array().cast("array<struct<x:struct<a:int,k:int,b:int,kind:string>,left:struct<b:int,a:int,kind:string>,right:struct<b:int,a:int,kind:string>>>"), let(S.struct(before.alias("before"), after.alias("after")), sweep))
