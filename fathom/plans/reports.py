"""Tables that compare settings: merges, deltas, highlights, histograms, text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_metrics(base: DataFrame, *others: DataFrame, key: str = "setting") -> DataFrame:
    """``base`` with the metrics of others by setting; what is missing is 0."""
    joined = reduce(lambda a, b: a.join(b, key, "left"), others, base)
    return joined.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in joined.columns if c != key])


def upsert(old: DataFrame, new: DataFrame, key: str = "setting") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    taken = F.col(f"n.{key}").isNotNull()
    return both.select(*[F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def highlight(rows: DataFrame, metrics: list[str], lowest: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with best_<metric>: whether a row holds the greatest value (the least for ``lowest``)."""
    best = rows.agg(*[(F.min if m in lowest else F.max)(m).alias(m) for m in metrics])
    limits = rows.select("*", *[best.select(m).scalar().alias(f"__{m}") for m in metrics])
    return limits.select(*rows.columns, *[(F.col(m) == F.col(f"__{m}")).alias(f"best_{m}") for m in metrics])


def deltas(rows: DataFrame, baseline: str, proposed: str, metrics: list[str], key: str = "setting") -> DataFrame:
    """(metric, baseline, proposed, delta) of two settings; a missing one counts as 0."""
    flat = rows.unpivot([key], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    side = lambda s: F.coalesce(F.max(F.when(F.col(key) == s, F.col("value"))), F.lit(0.0))
    return flat.groupBy("metric").agg(F.round(side(baseline), 6).alias("baseline"), F.round(side(proposed), 6).alias("proposed"), F.round(side(proposed) - side(baseline), 6).alias("delta"))


def failures(rows: DataFrame, settings: tuple[str, ...] | None = None) -> DataFrame:
    """(setting, query_type, failures): queries without a hit; each query of a setting counts once."""
    missed = rows.where(~F.col("hit"))
    if settings:
        missed = missed.where(F.col("setting").isin(*settings))
    once = missed.select("setting", F.coalesce("query_type", F.lit("UNKNOWN")).alias("query_type"), "qid").distinct()
    return once.groupBy("setting", "query_type").agg(F.count("*").alias("failures"))


def best_setting(rows: DataFrame, metric: str, key: str = "setting", order: str | None = None) -> DataFrame:
    """One row: the setting with the greatest metric, the first in order on ties."""
    ranked = F.row_number().over(Window.orderBy(F.desc("value"), "place"))
    per = rows.groupBy(F.col(key).alias("setting")).agg(F.max(metric).alias("value"), F.min(order or key).alias("place"))
    return per.orderBy(F.desc("value"), "place").limit(1).select("setting", "value") if order is None else per.withColumn("r", ranked).where("r = 1").select("setting", "value")


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", value.cast("double"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(rows: DataFrame, order: list[str], digits: int = 4) -> str:
    """A table of a report's few rows as markdown."""
    shown = rows.orderBy(*order).select(*[fixed(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n).cast("string").alias(n) for n, t in rows.dtypes])
    head = [f"| {' | '.join(shown.columns)} |", f"| {' | '.join('---' for _ in shown.columns)} |"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else v for v in r)} |" for r in shown.toLocalIterator()])


def aligned(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows as lines of columns padded to the widest value."""
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    wide = text.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in text.columns])
    padded = text.select(*order, *[wide.select(c).scalar().alias(f"w_{c}") for c in text.columns], *[F.col(c).alias(f"v_{c}") for c in text.columns])
    return padded.orderBy(*order).select(F.concat_ws("  ", *[F.rpad(F.col(f"v_{c}"), F.col(f"w_{c}"), F.lit(" ")) for c in text.columns]).alias("line"))
