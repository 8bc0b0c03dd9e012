"""Secret scans with linking of credentials that come in several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.llm.common import replace_columns
from fathom.llm.spans import by_place, count_kind, find_spans, with_neighbours, written
from fathom.llm.sqltext import S, Sql, let, text_or_empty

#: The shapes of secrets.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak on their own: a user or client name, a host to log in to, a string that looks random.
IDENTITY = r"""(?i:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x20\x09-\x0D"'<>]+"""
RANDOM = r"""(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"""

BASE = ("assign", "access", "hex")
WEAK = ("identity", "endpoint", "random")
KINDS = (*BASE, *WEAK)
#: What each weak kind needs nearby: names need a secret or an access identifier, a random string a name.
COMPLEMENT = {"identity": ("access", "assign", "hex", "random"), "endpoint": ("access", "assign", "hex", "random"), "random": ("access", "identity", "endpoint")}
#: Code points between the parts of one credential, at most: how far a scope reaches from a part.
SCOPE = 300

_PLACES = "array<struct<a:int,k:int,b:int,kind:string>>"
_LINKS = "array<struct<a:int,b:int,kind:string,with_a:int,with_b:int,with_kind:string>>"


def _looks_random(m: Sql) -> Sql:
    return S.rlike(m, "[0-9]") & S.rlike(m, "[a-z]") & S.rlike(m, "[A-Z]")


def _is(x: Sql, kinds: tuple[str, ...]) -> Sql:
    return x["kind"].isin(*kinds)


def _free(placed: Sql) -> Sql:
    """The places without weak ones that overlap a base one."""
    swept = with_neighbours(placed, lambda x: _is(x, BASE))
    clear = S.filter(swept, lambda s: _is(s["x"], BASE) | (S.coalesce(s["left"]["b"] <= s["x"]["a"], True) & S.coalesce(s["right"]["a"] >= s["x"]["b"], True)))
    return S.transform(clear, lambda s: s["x"])


def _links(placed: Sql, kinds: tuple[str, ...], scope: int) -> Sql:
    """Places of ``kinds`` (of one complement), each with its nearest complement within the scope."""

    def gap(s: Sql, side: str) -> Sql:
        away = s["x"]["a"] - s["left"]["b"] if side == "left" else s["right"]["a"] - s["x"]["b"]
        return S.when(away <= scope, S.greatest(away, 0))

    def nearest(s: Sql) -> Sql:
        left = gap(s, "left") <= S.coalesce(gap(s, "right"), scope + 1)
        return S.when(left, s["left"], S.when(S.isnotnull(gap(s, "right")), s["right"]))

    swept = S.filter(with_neighbours(placed, lambda x: _is(x, COMPLEMENT[kinds[0]])), lambda s: _is(s["x"], kinds))
    met = S.filter(S.transform(swept, lambda s: S.struct(s["x"].alias("x"), nearest(s).alias("y"))), lambda m: S.isnotnull(m["y"]))
    return S.transform(met, lambda m: S.struct(*[m[side][c].alias(name + c) for side, name in (("x", ""), ("y", "with_")) for c in ("a", "b", "kind")])).cast(_LINKS)


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``secrets``: an array of (a, k, b, kind), by start; a and b in code points; and
    ``secret_links``: (a, b, kind, with_a, with_b, with_kind), by start.

    Base kinds, leftmost and not overlapping within a kind: ``assign`` (a name and a value of 6
    characters or more), ``access`` (an access identifier of 20 or more), ``hex`` (24 hexadecimal
    digits or more). They stand on their own.

    Linked kinds are weak candidates: ``identity`` (a user, client or key name), ``endpoint`` (an
    address with a scheme) and ``random`` (20 or more characters of mixed case with digits). The
    parts of a document meet in an interval join, which sweeps over the sorted places once forth and
    once back: a candidate's scope is its place and ``scope`` code points on either side, and it is
    reported only with a complement there (``COMPLEMENT``). Of several the nearest is its link, the
    one on the left if both sides are as near. Linked spans never overlap base ones.

    All of it is arrays within the row, in time that follows the text: no shuffle, no Python. Null
    text counts as empty and has none. Rows are independent: repeated rows give the same twice, an
    empty table an empty one. Input columns named like the two new ones, in any case, give way.
    """
    t = text_or_empty(text)
    assign = S.filter(find_spans(t, ASSIGN, S.rlike(t, "(?i:password|passwd|secret|token|api_?key)")), lambda x: S.length(S.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    parts = {
        "assign": assign,
        "access": find_spans(t, ACCESS, S.contains(t, "AKIA")),
        "hex": find_spans(t, HEX, S.rlike(t, HEX)),
        "identity": find_spans(t, IDENTITY, S.rlike(t, "(?i:user|login|client|access|account)")),
        "endpoint": find_spans(t, ENDPOINT, S.contains(t, "://")),
        "random": S.filter(find_spans(t, RANDOM, S.rlike(t, RANDOM)), lambda x: _looks_random(x["m"])),
    }

    def link(placed: Sql) -> Sql:
        found = S.array_sort(S.concat(_links(placed, ("identity", "endpoint"), scope), _links(placed, ("random",), scope)))

        def report(links: Sql) -> Sql:
            weak = S.transform(links, lambda x: S.struct(x["a"].alias("a"), S.array_position(S.array(*KINDS), x["kind"]).cast("int").alias("k"), x["b"].alias("b"), x["kind"].alias("kind")))
            weak = S.transform(weak, lambda x: S.struct(x["a"].alias("a"), (x["k"] - 1).alias("k"), x["b"].alias("b"), x["kind"].alias("kind"))).cast(_PLACES)
            return S.struct(S.sort_array(S.concat(S.filter(placed, lambda x: _is(x, BASE)), weak)).alias("secrets"), links.alias("links"))

        return let(found, report)

    def scan(placed: Sql) -> Sql:
        alone = S.struct(placed.alias("secrets"), S.array().cast(_LINKS).alias("links"))
        return S.when(~S.exists(placed, lambda x: _is(x, WEAK)), alone, let(_free(placed), link))

    scanned = let(by_place(parts).cast(_PLACES), scan)
    held = replace_columns(docs, {"secrets": scanned.column()})
    return replace_columns(held, {"secrets": F.col("secrets.secrets"), "secret_links": F.col("secrets.links")})


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: counts and a hash of the base spans, all spans, and the links as text
    (kind:start:end>kind:start:end). Nulls, repeats and empty tables are as in ``scan_secrets``."""
    found = scan_secrets(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text")
    all_ = S.col("secrets")
    base = S.filter(all_, lambda x: x["k"] < len(BASE))
    counts = [count_kind(all_, k).alias(f"n_{kind}").column() for k, kind in enumerate(BASE)]
    links = S.array_join(S.transform(S.col("secret_links"), lambda x: S.format_string("%s:%d:%d>%s:%d:%d", x["kind"], x["a"], x["b"], x["with_kind"], x["with_a"], x["with_b"])), ",")
    return found.select(F.col("__id").alias(id_col), *counts, S.sha2(written(base), 256).alias("base_sha256").column(), written(all_).alias("spans").column(), links.alias("links").column())
