"""Quality rules by weak supervision: votes, estimated accuracies, posterior probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.common import let, split_words, text_or_empty
from fathom.runtime import materialize

#: Steps of expectation-maximisation; accuracies of this many rules settle well before.
STEPS = 25


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of ``window`` words (a power of two) that occur twice or more, the first
    occurrence included.

    Windows are hashed by doubling: a hash of two neighbours, of two such, and so on. Only a text
    with an equal pair of hashes is sorted to find where they lie.
    """

    def double(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.when(F.size(h) > step, F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, 1 + step, F.size(h) - step), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>")))

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < window:
        hashes = double(hashes, step)
        step *= 2

    def places(sorted_: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])
            after = F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, places), covered))

    return let(hashes, count).cast("long")


def text_figures(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """What the rules look at, each a column over ``docs``."""
    t = text_or_empty(text)
    words = split_words(t)
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit("[A-Z]{2}")).cast("long"),
        "n_shouts": F.regexp_count(t, F.lit("!")).cast("long"),
        "n_ends": F.regexp_count(t, F.lit(r"[.?](?=[\x20\n]|\z)")).cast("long"),
        "n_edges": F.regexp_count(t, F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)")).cast("long"),
        "n_plain": F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x00-\x40\x5B-\x60\x7B-\x7F]++[.,;:?]?(?![^\x20\x09-\x0D])")).cast("long"),
    }


def votes() -> list[Column]:
    """One column a rule: 1 for good, -1 for bad, 0 if it abstains. All divisions are by words."""

    def by(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    n = F.col("n_words")
    length = F.col("word_chars") / F.nullif(n, F.lit(0))
    return [
        by(10 * F.col("n_symbols") >= n, 50 * F.col("n_symbols") <= n),
        by(10 * F.col("n_edges") >= n, 50 * F.col("n_edges") <= n),
        by(4 * F.col("n_plain") <= 3 * n, 20 * F.col("n_plain") >= 19 * n),
        by(4 * F.col("n_capitals") >= n, 20 * F.col("n_capitals") <= n),
        by(10 * F.col("n_shouts") >= n, 50 * F.col("n_shouts") <= n),
        by(4 * F.col("n_dup_lines") >= F.greatest(F.col("n_lines"), F.lit(2)), F.col("n_dup_lines") == 0),
        by(10 * F.col("n_repeat_words") > 3 * n, 50 * F.col("n_repeat_words") <= n),
        by((n >= 20) & (F.col("n_distinct") * 5 <= n), F.col("n_distinct") * 3 >= n),
        by((length < 2.5) | (length > 15), (length >= 3) & (length <= 10)),
        by((n >= 40) & (100 * F.col("n_ends") < n), (n >= 40) & (40 * F.col("n_ends") >= n)),
    ]


#: Rules that look at the same thing: symbols, capitals and exclamation marks, repetition. The others
#: stand alone. By their places in ``votes``.
FAMILIES = ((0, 1, 2), (3, 4), (5,), (6, 7), (8,), (9,))
#: A vote is wrong in this share of all cases, whatever the votes have shown.
NOISE = 0.01


def _verdict(prior: Column, weights: Column, vote: Column) -> Column:
    """Probability of good from the estimated rates, for the verdict.

    Rules of a family mostly vote alike, so a family counts as one vote: the mean log likelihood ratio
    of those that are cast. And no rate is better than NOISE allows: where no good document has cast
    a bad vote yet, that vote still weighs no more than its true rate against NOISE. So one bad vote
    does not sink a document that the other families speak for; a whole family does, or two.
    """

    def noisy(rate: Column) -> Column:
        return NOISE + (1 - 2 * NOISE) * rate

    def says(j: int) -> Column:
        v, w = F.get(vote, F.lit(j)), F.get(weights, F.lit(j))
        false, true = noisy(w["false"]), noisy(w["true"])
        return F.when(v == 1, F.ln((1 - false) / (1 - true))).when(v == -1, F.ln(false / true)).otherwise(F.lit(0.0))

    odds = F.ln(prior / (1 - prior))
    for family in FAMILIES:
        cast = sum((F.abs(F.get(vote, F.lit(j))) for j in family), F.lit(0))
        odds = odds + sum((says(j) for j in family), F.lit(0.0)) / F.greatest(cast, F.lit(1))
    return 1 / (1 + F.exp(-odds))


def _posterior(prior: Column, weights: Column, vote: Column) -> Column:
    """Probability of good while rates are estimated: each cast vote adds its log likelihood ratio to
    the prior's log odds."""
    said = F.zip_with(vote, weights, lambda v, w: F.when(v == 1, w["up"]).when(v == -1, w["down"]).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-F.aggregate(said, F.ln(prior / (1 - prior)), lambda s, x: s + x)))


#: What a rule is taken to do before the votes are seen, with the weight of so many votes: it calls
#: a good document bad in FALSE of its votes and a bad one in TRUE.
FALSE, TRUE, WEIGHT = 0.02, 0.3, 20.0
#: The share of good documents before the votes are seen, with the same weight.
GOOD = 0.8


def rule_model(voted: DataFrame, rules: int, steps: int = STEPS) -> DataFrame:
    """One row (prior, weights): what expectation-maximisation makes of the votes.

    Each rule has two rates, of bad votes among the votes that it casts on good and on bad
    documents. Given the truth rules vote independently, and abstain regardless of it. Documents of
    equal votes count together, so the model sees at most 3**rules patterns with their counts, in
    one row, and the steps are a fold over that row. Rates are as the votes have them, but for
    WEIGHT votes cast beforehand, which keep them off 0 and 1. Weights are the rates (false, true) and
    the log likelihood ratios of a good (up) and a bad (down) vote. That rules of a family vote alike
    is what tells good documents from bad ones here; the verdict doesn't count it thrice
    (``_verdict``). No rows give the rates taken beforehand.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    every = F.sequence(F.lit(0), F.lit(rules - 1))

    def weigh(false: Column, true: Column) -> Column:
        return F.struct(F.ln((1 - false) / (1 - true)).alias("up"), F.ln(false / true).alias("down"), false.alias("false"), true.alias("true"))

    start = F.struct(F.lit(GOOD).alias("prior"), F.array_repeat(weigh(F.lit(FALSE), F.lit(TRUE)), rules).alias("weights"))

    def total(e: Column, of) -> Column:
        return F.aggregate(e, F.lit(0.0), lambda s, x: s + of(x))

    def step(state: Column, _: Column) -> Column:
        def renew(e: Column) -> Column:
            def rule(j: Column) -> Column:
                def vote(x: Column) -> Column:
                    return F.get(x["v"], j)

                def rate(of, before: float) -> Column:
                    bad = total(e, lambda x: F.when(vote(x) == -1, of(x)).otherwise(F.lit(0.0)))
                    cast = total(e, lambda x: F.when(vote(x) != 0, of(x)).otherwise(F.lit(0.0)))
                    return (bad + F.lit(WEIGHT * before)) / (cast + F.lit(WEIGHT))

                # a rule that would call bad documents bad more rarely than good ones says nothing
                true = rate(lambda x: x["n"] * (1 - x["p"]), TRUE)
                both = F.struct(rate(lambda x: x["n"] * x["p"], FALSE).alias("f"), true.alias("t"))
                return let(both, lambda r: weigh(r["f"], F.greatest(r["t"], r["f"])))

            good, n = total(e, lambda x: x["n"] * x["p"]), total(e, lambda x: x["n"])
            prior = (good + F.lit(WEIGHT * GOOD)) / (n + F.lit(WEIGHT))
            return F.struct(prior.alias("prior"), F.transform(every, rule).alias("weights"))

        seen = F.transform("patterns", lambda x: F.struct(x["votes"].alias("v"), x["n"].cast("double").alias("n"), _posterior(state["prior"], state["weights"], x["votes"]).alias("p")))
        return let(seen, renew)

    model = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return row.select(model.alias("m")).select("m.prior", "m.weights")


def _with_quality(voted: DataFrame, model: DataFrame) -> DataFrame:
    """``voted`` with the posterior of its votes; the model is a scalar subquery, found once."""
    held = voted.withColumn("__m", model.select(F.struct("prior", "weights")).scalar())
    return held.withColumn("quality", _verdict(F.col("__m.prior"), F.col("__m.weights"), F.col("votes"))).drop("__m")


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, the base figures, base_failed, quality, kept) of each row of ``docs``.

    Every rule votes or abstains; expectation-maximisation over the counts of vote patterns gives
    the rules' accuracies without labels; ``quality`` is the posterior probability that a document
    is good, with rules of a family counted as one vote and no rule trusted beyond NOISE, and ``kept`` says that it reaches ``threshold`` and the base rules hold: at least 20
    words, at most 30 % of them in repeated windows of 8.

    Texts are read once; the figures go to a table of the shared folder, and only they are read by
    the model and the verdict. The model is one row, a scalar subquery.

    Null and empty texts have no words and fail. Repeated rows count and are judged each. An empty
    table gives an empty table. Other columns of ``docs`` play no part.
    """
    figures = docs.select(F.col(f"`{id_col}`").alias("__id"), *[c.alias(n) for n, c in text_figures(docs, text).items()])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = votes()
    slim = materialize(figures.select("__id", *FIGURES, failed.alias("base_failed"), F.array(*rules).alias("votes")), "quality")
    model = rule_model(slim, len(rules))
    judged = _with_quality(slim, model)
    return judged.select(F.col("__id").alias(id_col), *FIGURES, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with their columns.

    The model is fitted on the votes of all rows; only the rows themselves that fail the base rules
    are not written. Null and empty texts fail and go, repeated rows are judged each, a null id is an
    id, columns of any name come back as they are, and an empty table gives an empty table.
    """
    rules = votes()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    held = docs.select(F.struct(*columns).alias("__row"), *[c.alias(n) for n, c in text_figures(docs, text).items()])
    passed = F.when(~failed, F.col("__row")).alias("__row")
    held = materialize(held.select(passed, failed.alias("__failed"), F.array(*rules).alias("votes")), "quality")
    model = rule_model(held, len(rules))
    return _with_quality(held.where("not __failed"), model).where(F.col("quality") >= threshold).select("__row.*")
