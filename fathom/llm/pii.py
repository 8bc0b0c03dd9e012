"""Personal data: fixed shapes, and bootstrapped contextual extraction of unseen identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.llm.spans import by_place, count_kind, find_spans, with_neighbours, written
from fathom.llm.sqltext import S, Sql, ascii_lower, let, text_or_empty
from fathom.runtime import discard, materialize

#: The shapes of personal data. \G and the look-behind only spare hopeless starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What an identifier may look like: letters, digits and joints with a digit, an underscore or an at sign.
TOKEN = r"(?:\G|(?<![A-Za-z0-9@._/+-]))(?=[A-Za-z./-]*+[0-9_@])[A-Za-z0-9@_][A-Za-z0-9@._/-]{3,}+"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "found")


def _digits(m: Sql) -> Sql:
    return S.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Sql) -> Sql:
    each = S.filter(S.split(S.reverse(digits), ""), lambda c: c != "")
    worth = S.transform(each, lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: S.when(x > 9, x - 9, x)))
    return S.aggregate(worth, 0, lambda s, x: s + x) % 10 == 0


def _identifies(m: Sql) -> Sql:
    """Four digits or more, letters with digits, or a name with an underscore or at sign in it."""
    return (S.length(_digits(m)) >= 4) | (S.rlike(m, "[0-9]") & S.rlike(m, "[A-Za-z]")) | S.rlike(m, "[A-Za-z0-9][_@][A-Za-z0-9]|@[A-Za-z]")


def base_spans(t: Sql, near: bool = False) -> dict[str, Sql]:
    """Spans of each base kind in a text that isn't null; a match that fails its test is dropped."""
    some = S.rlike(t, "[0-9]")
    card = S.filter(find_spans(t, CARD, some, near), lambda x: let(_digits(x["m"]), lambda d: S.when(S.length(d).between(12, 19), _luhn(d), False)))
    phone = S.filter(find_spans(t, PHONE, S.contains(t, "+"), near), lambda x: S.length(_digits(x["m"])).between(9, 15))
    ip = S.filter(find_spans(t, IP, S.rlike(t, r"[0-9]\.[0-9]"), near), lambda x: S.forall(S.split(x["m"], r"\."), lambda n: S.coalesce(n.try_cast("long"), 999) <= 255))
    return {"email": find_spans(t, EMAIL, S.contains(t, "@"), near), "ip": ip, "card": card, "phone": phone}


#: Code points next to a place that are looked at first; only where they don't hold two words whole are more.
FIRST_LOOK = 48
_WHITE, _BLACK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _two_words(near: Sql, far: Sql, one: bool = False) -> Sql:
    """The first two words of ``near`` if it holds them whole, else of ``far``, with the punctuation
    that they touch; with ``one``, one word if there are no more; else empty."""
    two = rf"\A{_WHITE}*({_BLACK}+{_WHITE}+{_BLACK}+)"
    short = S.left(near, FIRST_LOOK)
    tries = [S.regexp_extract(short, two + _WHITE, 1), S.regexp_extract(near, two + _WHITE, 1), S.regexp_extract(far, two, 1)]
    tries += [S.regexp_extract(far, rf"\A{_WHITE}*({_BLACK}+)", 1)] * one
    return S.coalesce(*[S.nullif(x, "") for x in tries], "")


def _before(near: Sql, far: Sql) -> Sql:
    """The last two words of what lies before a place, in lower case."""
    return ascii_lower(S.reverse(_two_words(S.reverse(S.right(near, 8 * FIRST_LOOK)), S.reverse(far), one=True)))


def _behind(far: Sql) -> Sql:
    """The first two words of what lies behind a place, in lower case."""
    return ascii_lower(_two_words(far, far))


def _instance(m: Sql) -> Sql:
    return S.xxhash64(S.regexp_replace(ascii_lower(m), "[^0-9a-z@.]", ""))


#: A bound on rounds that only guards against a graph that never settles.
MOST_ROUNDS = 200
#: Scores that rise by less than this in sum have settled.
SETTLED = 1e-6


def trusted_patterns(seen: DataFrame, rounds: int = MOST_ROUNDS, min_seeds: int = 5, confidence: float = 0.7) -> DataFrame:
    """Patterns (context) that mostly lead to identifiers, from edges (context, instance, seed).

    Edges are the pattern-instance graph, one for each distinct pair. An instance's trust starts at
    1 for a seed and 0 otherwise; a pattern's score is the mean trust of its instances, and it is
    trusted from ``confidence`` on if its instances have ``min_seeds`` of trust in sum. Each round
    the instances of trusted patterns take over the pattern's score, so that patterns further from
    the seeds can follow, until no pattern joins and no score rises: trust only ever grows, so
    rounds end, and ``rounds`` merely bounds them. Every step is an aggregate with partial sums.
    """
    edges = seen.groupBy("context", "instance").agg(F.max("seed").cast("double").alias("seed"))
    edges = materialize(edges, "pii-graph")
    trust = edges.groupBy("instance").agg(F.max("seed").alias("trust"))
    good, before = None, None
    for _ in range(rounds):
        scored = edges.join(trust, "instance").groupBy("context").agg(F.avg("trust").alias("score"), F.sum("trust").alias("mass"))
        last, good = good, materialize(scored.where((F.col("score") >= confidence) & (F.col("mass") >= min_seeds)), "pii-patterns")
        if last is not None:
            discard(last)
        n, scores = good.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if before is not None and n == before[0] and scores - before[1] < SETTLED:
            break
        before = (n, scores)
        lent = edges.join(good, "context").groupBy("instance").agg(F.max("score").alias("lent"))
        trust = edges.groupBy("instance").agg(F.max("seed").alias("seed")).join(lent, "instance", "left")
        trust = trust.select("instance", F.greatest("seed", F.coalesce("lent", F.lit(0.0))).alias("trust"))
    return good.select("context", "score")


_SEEN = "array<struct<a:int,b:int,pattern:string,instance:bigint,seed:int>>"


def _overlap_free(tokens: Sql, base: Sql) -> Sql:
    """Tokens that touch no base span, by one sweep over the places of both."""

    def clear(s: Sql) -> Sql:
        return S.coalesce(s["left"]["b"] <= s["x"]["a"], True) & S.coalesce(s["right"]["a"] >= s["x"]["b"], True)

    def sweep(placed: Sql) -> Sql:
        # tokens are in order of their places, and so is what is left of the sweep
        swept = S.filter(with_neighbours(placed, lambda x: x["kind"] == "base"), lambda s: s["x"]["kind"] == "token")
        judged = S.zip_with(tokens, S.transform(swept, clear), lambda x, ok: S.struct(x.alias("x"), ok.alias("ok")))
        return S.transform(S.filter(judged, lambda z: z["ok"]), lambda z: z["x"])

    return S.when((S.size(tokens) == 0) | (S.size(base) == 0), tokens, let(by_place({"base": base, "token": tokens}), sweep))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = MOST_ROUNDS, min_seeds: int = 5, confidence: float = 0.7) -> DataFrame:
    """(id, pii) of each row: pii is an array of (a, k, b, kind) by start; a and b in code points.

    Base kinds are ``email``, ``ip``, ``card`` (passing Luhn's test) and ``phone``. They are the
    seeds: the two words before one are a lexical pattern (one word, if the text starts with it), and
    so are the two words behind it. Tokens that may be identifiers (with four digits, with
    letters and digits, or with an underscore or at sign inside) at the same patterns are instances;
    trust runs over the graph of patterns and instances until it settles (``rounds`` at most), and
    tokens at trusted patterns are reported as ``found`` unless they overlap a base span. Words of a
    pattern are sought as far as the second match before (behind) of the same kind.

    Texts are read once; places and contexts, a small part of them, go to a table of the shared
    folder. The graph is aggregated by pattern and by instance with partial sums, so a pattern that
    a third of all tokens stand at is no single task's burden. Work per text follows its length.

    Null text counts as empty. A repeated row is scanned each time; a null id is an id. Empty
    tables give empty tables.
    """
    t = text_or_empty(text)

    def places(p: Sql) -> Sql:
        def with_patterns(spans: Sql, seed: bool) -> Sql:
            def edges(x: Sql) -> Sql:
                def edge(side: str, words: Sql) -> Sql:
                    return S.struct(x["a"].alias("a"), x["b"].alias("b"), S.when(words != "", S.concat(side, words)).alias("pattern"), _instance(x["m"]).alias("instance"), S.lit(int(seed)).alias("seed"))

                return S.array(edge("<", _before(x["l"], x["l2"])), edge(">", _behind(x["r"])))

            return S.flatten(S.transform(spans, edges)).cast(_SEEN)

        base = S.concat(*[p[k] for k in BASE])
        tokens = S.filter(p["token"], lambda x: _identifies(x["m"]))
        seen = let(S.struct(base.alias("base"), tokens.alias("tokens")), lambda q: S.concat(with_patterns(q["base"], True), with_patterns(_overlap_free(q["tokens"], q["base"]), False)))
        return S.struct(by_place({k: p[k] for k in BASE}).alias("base"), S.filter(seen, lambda x: S.isnotnull(x["pattern"])).alias("near"))

    kinds = base_spans(t, True) | {"token": find_spans(t, TOKEN, S.rlike(t, "[0-9_@]"), True)}
    placed = let(S.struct(*[c.alias(k) for k, c in kinds.items()]), places).column()
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.monotonically_increasing_id().alias("__row"), placed.alias("p"))
    slim = materialize(slim.select("__id", "__row", "p.base", "p.near"), "pii")
    tokens = slim.select("__row", F.explode("near").alias("x")).select("__row", "x.*").withColumnRenamed("pattern", "context")
    good = trusted_patterns(tokens.select("context", "instance", "seed"), rounds, min_seeds, confidence)
    more = tokens.where("seed = 0").join(good, "context", "left_semi").groupBy("__row").agg(F.collect_set(F.struct("a", F.lit(len(BASE)).alias("k"), "b", F.lit("found").alias("kind"))).alias("found"))
    wide = slim.select("__id", "__row", "base").join(more, "__row", "left")
    return wide.select(F.col("__id").alias(id_col), F.when(F.col("found").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "found"))).alias("pii"))


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: counts and a hash of the base spans, and all spans as text. Nulls, repeats
    and empty tables are as in ``scan_pii``."""
    found = scan_pii(docs, id_col, text)
    all_ = S.col("pii")
    base = S.filter(all_, lambda x: x["k"] < len(BASE))
    counts = [count_kind(all_, k).alias(f"n_{kind}").column() for k, kind in enumerate(BASE)]
    return found.select(id_col, *counts, S.sha2(written(base), 256).alias("base_sha256").column(), written(all_).alias("spans").column())
