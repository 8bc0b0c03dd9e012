"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.common import WORD, text_or_empty
from fathom.runtime import materialize

#: Bins of the rank order; only the bin where a source's budget ends is sorted document by document.
BINS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources in code point order, null last, take ``weights`` in turn. They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared
    again. The level at which this ends has a closed form once sources are sorted by the level at
    which each is full, so there is no iteration. One row of a few numbers per source is all that
    meets in one task: millions of sources fit, a source per document wouldn't.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / free)
    # the first source that isn't full at its own level sets the level of all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("full"), (-F.col("level")).alias("level"))))
    per = per.withColumn("level", -level.over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the key alone, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12)
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _rank(u: Column, p: Column) -> Column:
    """Pareto rank: random odds over inclusion odds."""
    return (u / (1 - u)) * (1 - p) / F.nullif(p, F.lit(0.0))


#: How much more readily a source's short documents are taken than its average ones, and these than its
#: long ones, at most.
TILT = 2.0


def _class(size: Column) -> Column:
    """Documents of a class are alike in size: the power of two below it, -1 for no words."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1).cast("int")


def inclusion_rates(sizes: DataFrame, targets: DataFrame, most: float = 3.0, tilt: float = TILT) -> DataFrame:
    """(source, class, rate, rest) for rows (source, size) and targets (source, source_size, target):
    how many copies of a document of each class are to be expected.

    Within a source, rates follow the root of the mean size over the class's size, so that a few long
    documents don't use up the source's words, within a factor of ``tilt`` either way and ``most``
    copies. They are scaled so that expected words are the target; classes whose rate stops at
    ``most`` come first in the order of rates, so the scale has a closed form. ``rest`` is what the
    whole parts of the rates leave of the target. A source has some twenty classes.
    """
    per = sizes.groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    held = targets.select(F.col("source").alias("of"), "target")
    per = per.join(held, F.col("source").eqNullSafe(F.col("of")))
    all_ = Window.partitionBy("source")
    mean = F.sum("words").over(all_) / F.nullif(F.sum(F.when(F.col("class") >= 0, F.col("docs"))).over(all_), F.lit(0))
    lean = F.sqrt(mean / (1.5 * F.pow(F.lit(2.0), F.col("class"))))
    per = per.withColumn("g", F.when(F.col("class") < 0, tilt).otherwise(F.greatest(F.lit(1 / tilt), F.least(F.lit(tilt), lean))))
    order = all_.orderBy(F.desc("g"), "class")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    per = per.withColumn("scale", F.try_divide(left, F.sum(F.col("words") * F.col("g")).over(onward)))
    fits = F.when(F.col("scale") * F.col("g") <= most, F.struct(-F.col("g"), F.col("class"), F.col("scale").alias("scale")))
    per = per.withColumn("scale", F.min(fits).over(all_)["scale"])
    full = F.when(F.col("target") > 0, most).otherwise(0.0)
    per = per.withColumn("rate", F.coalesce(F.least(F.lit(float(most)), F.greatest(F.col("scale"), F.lit(0.0)) * F.col("g")), full))
    rest = F.col("target") - F.sum(F.floor("rate") * F.col("words")).over(all_)
    return per.select("source", "class", "rate", rest.alias("rest"))


NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def _mix(docs: DataFrame, id_col: str, text: str, source: str, weights: Sequence[float], share: float, most: float, closing: int, seed: int) -> DataFrame:
    """(row, size, source_size, target, rate, copies, taken): each row of ``docs`` as a struct, and its part."""
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    key, u = F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`")), _uniform(F.col(f"`{id_col}`"), seed)
    slim = materialize(docs.select(F.col(f"`{source}`").alias("source"), size.alias("size"), u.alias("u"), key.alias("k")), "mix")
    slim = slim.withColumn("class", _class(F.col("size")))
    targets = materialize(source_targets(slim, weights, share, most), "mix-targets")
    rates = inclusion_rates(slim, targets, most).withColumnRenamed("source", "of")
    per = rates.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    per = materialize(per.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")), "mix-sources")

    def of_class(d: str, s: str) -> Column:
        return F.col(f"{d}.source").eqNullSafe(F.col(f"{s}.source")) & (F.col(f"{d}.class") == F.col(f"{s}.class"))

    odds = _rank(F.col("u"), F.col("p"))
    ranked = slim.alias("d").join(per.alias("s"), of_class("d", "s")).where("p > 0")
    ranked = ranked.select(F.col("s.source").alias("source"), "size", "k", "rest", odds.alias("q"))
    ranked = ranked.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BINS)).cast("int"))
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(order)).withColumn("below", F.col("upto") - F.col("words"))
    border = sums.where("below < rest and upto >= rest").select(F.col("source").alias("bs"), F.col("bin").alias("bb"), "below")
    inside = ranked.join(border, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bin") == F.col("bb")))
    run = Window.partitionBy("source").orderBy("q", "k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("run", F.col("below") + F.sum("size").over(run))
    taken = inside.where(F.col("run") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("q", "k")).alias("last"))
    cut = border.join(taken, F.col("source").eqNullSafe(F.col("bs")), "left")
    cut = cut.select("bs", F.coalesce(F.col("last"), F.struct((F.col("bb") / BINS / (1 - F.col("bb") / BINS)).alias("q"), F.lit(-(2**63)).alias("k"))).alias("last"))
    # a source whose order never reaches its rest takes all, one with nothing left takes none
    per = per.join(cut, F.col("source").eqNullSafe(F.col("bs")), "left").drop("bs")
    extra = F.when(F.col("p") <= 0, False).otherwise(F.when(F.col("last").isNull(), F.col("rest") > 0).otherwise(F.struct(odds.alias("q"), F.col("k").alias("k")) <= F.col("last")))
    per = materialize(per.withColumn("switch", F.array().cast("array<long>")), "mix-plan")

    for _ in range(closing):
        one = extra != F.array_contains("switch", F.col("k"))
        picked = slim.alias("d").join(per.alias("s"), of_class("d", "s"))
        picked = picked.select(F.col("s.source").alias("source"), "size", "k", "u", "rest", "p", one.alias("extra"), F.array_contains("switch", F.col("k")).alias("done"))
        gap = picked.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"), F.first("rest").alias("rest"))
        gap = gap.select(F.col("source").alias("gs"), (F.col("rest") - F.col("got")).alias("gap"))
        # rows that share id and source switch together, so only keys count
        units = picked.where("size > 0 and p > 0 and not done").groupBy("source", "k").agg(F.sum("size").alias("size"), F.first("extra").alias("extra"))
        after = F.abs(F.col("gap") - F.when(F.col("extra"), -F.col("size")).otherwise(F.col("size")))
        better = units.join(gap, F.col("source").eqNullSafe(F.col("gs"))).where(after < F.abs("gap"))
        best = better.groupBy("source").agg(F.min(F.struct(after.alias("a"), F.col("k"))).alias("m")).select(F.col("source").alias("ws"), F.array("m.k").alias("more"))
        per = per.join(best, F.col("source").eqNullSafe(F.col("ws")), "left").drop("ws")
        per = materialize(per.withColumn("switch", F.concat("switch", F.coalesce("more", F.array().cast("array<long>")))).drop("more"), "mix-plan")

    def planned(c: str) -> Column:
        return F.col(f"plan.{c}")

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("of"), size.alias("size"), u.alias("u"), key.alias("k"))
    plan = per.select(F.col("source").alias("at"), F.col("class").alias("alike"), F.struct(*[F.col(c) for c in per.columns]).alias("plan"))
    wide = held.join(plan, F.col("of").eqNullSafe(F.col("at")) & (_class(F.col("size")) == F.col("alike")))
    q = _rank(F.col("u"), planned("p"))
    one = F.when(planned("p") <= 0, False).otherwise(F.when(planned("last").isNull(), planned("rest") > 0).otherwise(F.struct(q.alias("q"), F.col("k").alias("k")) <= planned("last")))
    one = one != F.array_contains(planned("switch"), F.col("k"))
    wide = wide.select("row", "size", planned("source_size").cast("long").alias("source_size"), planned("target").alias("target"), planned("rate").alias("rate"), (planned("whole") + one.cast("long")).cast("long").alias("copies"))
    return wide.select("row", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, closing: int = 3, seed: int = 17) -> DataFrame:
    """How often a mix takes each document: ``docs`` with size, source_size, target, rate, copies, taken.

    ``rate`` is how many copies of a document are to be expected (``inclusion_rates``): documents of a
    source differ in it by their size. Every document first gets the whole part of its rate as
    certain copies. The fraction is its inclusion probability p for one copy more: with u a fixed
    random number of the document, all documents of a source, whatever their p, are ranked by
    (u/(1-u))/(p/(1-p)) and taken in that order until the source's words are spent (the document on
    the border is taken if its middle is within), which is where the rank is about 1. Last, ``closing``
    times, the one document whose switch between taken and not brings its source nearest to the
    target is switched. The order is cut into bins whose sums fix the border, so only one bin of a
    source is ever sorted and a source with a third of all rows is spread over the tasks.

    Size is the number of words; null texts have size 0. Rows of one id and source share u and
    their fate. A null source is a source, the last one; a null id is an id. Ties of the hash keep
    together. Input columns named like the six new ones, in any case, give way to them; an empty
    table gives an empty table.
    """
    mixed = _mix(docs, id_col, text, source, weights, share, most, closing, seed)
    rest = [c for c in docs.columns if c.lower() not in NEW]
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *NEW)


def draw_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, closing: int = 3, seed: int = 17) -> DataFrame:
    """The rows of a mix: each row of ``docs`` as often as ``mix_sources`` takes it, with the columns of
    ``docs``, whatever their names. Nulls, ties, repeated rows and empty tables are as there."""
    mixed = _mix(docs, id_col, text, source, weights, share, most, closing, seed).where("copies > 0")
    every = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
