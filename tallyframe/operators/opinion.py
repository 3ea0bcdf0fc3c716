"""Opinions: de-duplication, dated windows, equal-unit aggregation, wide features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import suppress


def first_of_duplicates(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of duplicates under a total order. min_by combines before the
    shuffle, so a text copied a million times isn't sorted in one task."""
    rest = [c for c in df.columns if c not in same]
    return df.groupBy(*same).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*same, *[F.col(f"__r.{c}").alias(c) for c in rest])


def duplicate_rank(df: DataFrame, same: list[str], order: str, out: str = "dup_rank", buckets: int = 128) -> DataFrame:
    """Rank of each row among its duplicates by ``order`` (unique, numeric or a time).

    A text that a third of all rows repeat is ranked in ``buckets`` parts of the order column, whose
    bounds come from one approximate aggregation; the ranks are exact.
    """
    from .sampling import split_rank

    bounds = df.agg(F.percentile_approx(F.col(order), [i / buckets for i in range(1, buckets)], 10000)).first()[0]
    if bounds is None:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    part = F.size(F.filter(cuts, lambda b: b < F.col(order)))
    return split_rank(df, same, part, [F.col(order)], out)


RESOLVED = ("positive", "negative", "neutral", "mixed")  # fixed values: polarities that are opinions


def balanced(df: DataFrame, unit: str, keys: list[str], polarity: str, min_opinions: int = 20, min_units: int = 5) -> DataFrame:
    """Net opinion per key, every unit (video, user) weighted alike.

    Two stages: per (unit, key) the ratio of its opinions, then the mean and population deviation of the
    ratios and the ratio of sums. Opinions are the resolved polarities; unresolved rows and rows without
    an opinion (or a null one) are counted and stay outside every ratio, and a unit with nothing else
    isn't among ``units``, only among ``observed_units``. Values are null below the support minima; the
    counts stay.
    """
    p = F.col(polarity)
    has = lambda *v: F.count(F.when(p.isin(*v), 1))
    per = df.groupBy(unit, *keys).agg(F.count("*").alias("__rows"), has(*RESOLVED).alias("__n"), has("positive").alias("__p"), has("negative").alias("__m"), has("unresolved").alias("__u"))
    ratio = F.when(F.col("__n") > 0, (F.col("__p") - F.col("__m")) / F.col("__n"))
    out = per.groupBy(*keys).agg(
        F.sum("__n").alias("opinions"), F.count(ratio).alias("units"), F.count("*").alias("observed_units"), F.sum("__p").alias("positive"), F.sum("__m").alias("negative"), F.sum("__u").alias("unresolved"),
        F.round(F.sum("__u") / F.sum("__rows"), 9).alias("unresolved_share"), F.avg(ratio).alias("__b"), F.stddev_pop(ratio).alias("__s"), F.try_divide(F.sum(F.col("__p") - F.col("__m")), F.sum("__n")).alias("__w"),
    )
    enough = (F.col("opinions") >= min_opinions, F.col("units") >= min_units)
    return out.select(
        *keys, "opinions", "units", "observed_units", "positive", "negative", "unresolved", "unresolved_share",
        suppress(F.round("__b", 9), *enough).alias("balanced_net"), suppress(F.round("__s", 9), *enough).alias("unit_std"), suppress(F.round("__w", 9), *enough).alias("weighted_net"),
        (~(enough[0] & enough[1])).alias("support_suppressed"),
    )


def collapse(polarities: str) -> Column:
    """Aggregate: one polarity of several clauses. No polarity, or an unresolved one, leaves it unresolved;
    positive with negative is mixed; anything else that is neither is neutral. Nulls don't count."""
    has = lambda v: F.coalesce(F.bool_or(F.col(polarities) == v), F.lit(False))
    return (
        F.when((F.count(polarities) == 0) | has("unresolved"), "unresolved").when(has("positive") & has("negative"), "mixed")
        .when(has("positive"), "positive").when(has("negative"), "negative").otherwise("neutral")
    )


def window_ends(df: DataFrame, date: str) -> DataFrame:
    """One row per month end from the first to the last month of ``date``."""
    span = df.agg(F.last_day(F.min(date)).alias("a"), F.last_day(F.max(date)).alias("b"))
    return span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("window_end"))


def in_windows(df: DataFrame, ends: DataFrame, date: str, months: int = 12) -> DataFrame:
    """Each row once per window that holds it: after the same day ``months`` calendar months before the
    window's end (the last day of a shorter month), up to the end. A row's month ends are listed from its
    own date, so the join with the ends (one row per month, broadcast) is an equality."""
    d = F.to_date(df[date])
    own = F.transform(F.sequence(F.trunc(d, "month"), F.trunc(F.add_months(d, months), "month"), F.expr("interval 1 month")), lambda m: F.last_day(m))
    rows = df.withColumn("window_end", F.explode(F.filter(own, lambda e: (d <= e) & (d > F.add_months(e, -months)))))
    return rows.join(F.broadcast(ends), "window_end")


def widen(df: DataFrame, keys: list[str], aspect: str, aspects: list[str], value: str) -> DataFrame:
    """One column per aspect and its _missing flag."""
    cols = []
    for a in aspects:
        v = F.max(F.when(F.col(aspect) == a, F.col(value)))
        cols += [v.alias(f"{a}_{value}"), v.isNull().cast("int").alias(f"{a}_missing")]
    return df.groupBy(*keys).agg(*cols)
