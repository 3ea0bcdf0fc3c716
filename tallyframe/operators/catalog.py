"""Faceted catalog queries: filters, summaries, histograms, pages, funnels."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, holds, quantile, sha_hex, with_row


@dataclass(frozen=True)
class Filters:
    """IN-lists by column, bounds by column (None: open). Unknown values fail a filter."""

    choices: dict[str, tuple] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)

    def expression(self) -> Column:
        parts = [F.col(c).isin(*v) for c, v in self.choices.items() if v]
        parts += [F.col(c) >= v for c, v in self.at_least.items()] + [F.col(c) <= v for c, v in self.at_most.items()]
        return reduce(lambda a, b: a & b, [holds(p) for p in parts], F.lit(True))


def cohort_summary(df: DataFrame, cohort: list[str], value: str, limit: int | None = None, error: float = 0.0) -> DataFrame:
    """Rows, median and quartiles (to 4 digits; see :func:`quantile` for ``error``) per cohort, largest first."""
    v = F.col(value)
    out = df.groupBy(*cohort).agg(F.count("*").alias("n"), *[F.round(quantile(v, p, error), 4).alias(a) for a, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))])
    out = out.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in cohort])
    return out.limit(limit) if limit else out


def scope_summary(df: DataFrame, identity: str, cohort: list[str], values: list[str], date: str | None = None, error: float = 0.0) -> DataFrame:
    """One row: rows, distinct identities, complete cohorts, median (see :func:`quantile` for ``error``) and
    finite range of each value. Counts, ends and, with ``error``, medians come from one pass; an exact median
    is taken over a column's counted different values, one more pass for each."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cohort])
    cols = [F.count("*").alias("n_rows"), F.count_distinct(identity).alias("n_ids"), F.count_distinct(F.when(complete, F.struct(*cohort))).alias("n_cohorts")]
    medians = []
    for v in values:
        x = finite(F.col(v).cast("double"))
        cols += [F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max")]
        if error:
            cols.append(quantile(x, 0.5, error).alias(f"{v}_median"))
        else:
            counted = df.select(x.alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
            medians.append(counted.agg(F.percentile("x", 0.5, F.col("n")).alias(f"{v}_median")))
    if date:
        cols += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    one = reduce(with_row, medians, df.agg(*cols))
    ends = ["first_date", "last_date"] if date else []
    return one.select("n_rows", "n_ids", "n_cohorts", *[f"{v}_{k}" for v in values for k in ("median", "min", "max")], *ends)


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows per left-closed bin of ``width``; nulls and NaN have no bin."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return ok.groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Rows of one page under a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def extremes(df: DataFrame, value: str, tie: str, k: int = 10) -> DataFrame:
    """The k largest and k smallest values, unique tie-break."""
    ok = df.filter(F.col(value).isNotNull())
    hi = ok.orderBy(F.col(value).desc(), F.col(tie)).limit(k).withColumn("side", F.lit("top"))
    lo = ok.orderBy(F.col(value).asc(), F.col(tie)).limit(k).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo)


def hash_sample(df: DataFrame, key: str, k: int, salt: str = "42") -> DataFrame:
    """The k rows with the smallest salted hash: the same rows whatever the partitioning."""
    return df.withColumn("__h", sha_hex(key, salt=salt)).orderBy("__h", key).limit(k).drop("__h")


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step_no, step, remaining, excluded: rows that pass each prefix of the predicates.

    All prefixes are counted in one aggregation over one scan; unknown counts as failing.
    """
    passed, cols = F.lit(True), [F.count("*").alias("__0")]
    for i, (_, p) in enumerate(steps, 1):
        passed = passed & holds(p)
        cols.append(F.count(F.when(passed, 1)).alias(f"__{i}"))
    one = df.agg(*cols)
    rows = [F.struct(F.lit(i).cast("bigint").alias("step_no"), F.lit(name).alias("step"), F.col(f"__{i}").alias("remaining"), (F.col(f"__{i - 1}") - F.col(f"__{i}")).alias("excluded")) for i, (name, _) in enumerate(steps, 1)]
    return one.select(F.inline(F.array(*rows)))


def supported(df: DataFrame, group: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows; the group sizes are aggregated, then semi-joined."""
    big = df.groupBy(*group).count().filter(F.col("count") >= least).select(*group)
    return df.join(big, group, "left_semi")


def broaden(df: DataFrame, scopes: list[tuple[str, Column]], least: int = 100) -> tuple[str, DataFrame]:
    """The first (narrowest) scope with ``least`` rows, else the last; all are counted in one job."""
    counts = df.agg(*[F.count(F.when(holds(p), 1)).alias(f"s{i}") for i, (_, p) in enumerate(scopes)]).first()
    pick = next((i for i in range(len(scopes)) if counts[i] >= least), len(scopes) - 1)
    return scopes[pick][0], df.filter(holds(scopes[pick][1]))
