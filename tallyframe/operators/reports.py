"""Reports over groups: united flags, mixtures, coverage, bins, agreement, reasons, inventories, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import quantile, with_row
from .metrics import wilson_gate


def united_shares(df: DataFrame, unit: list[str], group: list[str], flags: dict[str, Column], usable: Column | None = None, least_units: int = 1, least_hits: int = 0) -> DataFrame:
    """``group``, the share of units with each flag, n units, supported: flags are united per (group, unit) before
    any share is taken; ``usable`` says which rows count. Shares are null without ``least_units`` units, or
    ``least_hits`` hits of the flag."""
    rows = df.filter(usable) if usable is not None else df
    per = rows.groupBy(*group, *unit).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"__{n}") for n, c in flags.items()])
    n = F.count("*")
    cols = [F.when((n >= least_units) & (F.count_if(f"__{x}") >= least_hits), F.round(F.avg(F.col(f"__{x}").cast("int")), 9)).alias(f"{x}_share") for x in flags]
    return per.groupBy(*group).agg(*cols, n.alias("n"), (n >= least_units).alias("supported"))


def mixtures(df: DataFrame, family: str, cluster: str, weight: str) -> DataFrame:
    """``family``, top_share, concentration (sum of squared shares), top_cluster, top_weighted: how a family's rows
    and weight spread over clusters."""
    c = df.groupBy(family, cluster).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    p = W.partitionBy(family)  # clusters of a family
    s = c.withColumn("share", F.col("n") / F.sum("n").over(p)).withColumn("wshare", F.try_divide(F.col("w"), F.sum("w").over(p)))
    return s.groupBy(family).agg(F.round(F.max("share"), 9).alias("top_share"), F.round(F.sum(F.col("share") * F.col("share")), 9).alias("concentration"), F.max_by(cluster, F.struct("share", cluster)).alias("top_cluster"), F.round(F.max("wshare"), 6).alias("top_weighted"))


def equal_bins(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """bin (from 1), n: equal bins between the ends of a column; a constant column is bin 1, nulls are left out."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    j = with_row(df.select(column).dropna(), ends)
    k = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins), F.lit(0.0))) + 1).cast("bigint")
    return j.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def log_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group`` and the five numbers of log(1 + value) with the upper fence, of the positive values."""
    s = df.filter(F.col(value) > 0).groupBy(group).agg(F.percentile(F.log1p(value), [0.0, 0.25, 0.5, 0.75, 1.0]).alias("v"))
    v = F.col("v")
    names = ["low", "q25", "median", "q75", "high"]
    return s.select(group, *[F.round(v[i], 6).alias(n) for i, n in enumerate(names)], F.round(v[3] + 1.5 * (v[3] - v[1]), 6).alias("upper_fence"))


def coverage(df: DataFrame, group: list[str], dimensions: list[str]) -> DataFrame:
    """``group``, dimension, n, observed, share: how far each dimension is filled, one row per group and dimension."""
    g = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count(c).alias(f"__{c}") for c in dimensions])
    long = g.select(*group, "n", F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(f"__{c}").alias("observed")) for c in dimensions])))
    return long.select(*group, "dimension", "n", "observed", F.round(F.col("observed") / F.col("n"), 9).alias("share"))


def requested(df: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` of ``grid``, n, mean, status: every segment asked for, no_rows where there is no data."""
    r = df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return grid.join(r, keys, "left").select(*keys, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean", F.when(F.col("n").isNull(), "no_rows").otherwise("ok").alias("status"))


def pooled_agreement(df: DataFrame, layer: list[str], fold: str, correct: Column, least: int, share: float, lower: float = 0.0) -> DataFrame:
    """``layer``, correct, emitted, agreement, deploy: sums over folds, not means of folds, and the gate on them."""
    f = df.groupBy(*layer, fold).agg(F.count(F.when(correct, 1)).alias("ok"), F.count("*").alias("n"))
    s = f.groupBy(*layer).agg(F.sum("ok").alias("correct"), F.sum("n").alias("emitted"))
    return s.select(*layer, "correct", "emitted", F.round(F.col("correct") / F.col("emitted"), 9).alias("agreement"), wilson_gate(F.col("correct"), F.col("emitted"), share, lower, least).alias("deploy"))


def reasons(rows: DataFrame, dimensions: list[str], rules: list[tuple[str, Column]], otherwise: str = "covered") -> DataFrame:
    """Every row once per dimension with ``reason``: the first rule that holds (they may name ``dimension``)."""
    long = rows.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions])))
    pick = None
    for name, c in rules:
        ok = F.coalesce(c, F.lit(False))
        pick = F.when(ok, name) if pick is None else pick.when(ok, name)
    return long.withColumn("reason", pick.otherwise(otherwise) if pick is not None else F.lit(otherwise))


def task_inventory(df: DataFrame, group: str, year: str, ids: str, inner: str, k: int) -> DataFrame:
    """``group``, first_year, last_year, n_ids, n_inner: the ``k`` groups with most ids (a top-k report)."""
    g = df.groupBy(group).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(ids).alias("n_ids"), F.count_distinct(inner).alias("n_inner"))
    return g.orderBy(F.col("n_ids").desc(), F.col(group).asc_nulls_last()).limit(k)


def error_concentration(df: DataFrame, segment: str, error: str, top: float = 0.99, rank_error: float = 0.0) -> DataFrame:
    """``segment``, n, share of the squared error, and the share that lies in the rows above the ``top`` quantile
    (see :func:`quantile` for ``rank_error``)."""
    e = df.withColumn("__sq", F.pow(F.col(error), 2))
    j = with_row(e, e.agg(quantile(F.col("__sq"), top, rank_error).alias("__cut"), F.sum("__sq").alias("__total")))
    return j.groupBy(segment).agg(F.count("*").alias("n"), F.round(F.sum("__sq") / F.max("__total"), 6).alias("share"), F.round(F.sum(F.when(F.col("__sq") >= F.col("__cut"), F.col("__sq"))) / F.max("__total"), 6).alias("top_share"))


def error_families(df: DataFrame, family: str, error: str, k: int = 20) -> DataFrame:
    """place, ``family``, n, share, running_share: the ``k`` families with most squared error (a top-k report)."""
    e = df.withColumn("__sq", F.pow(F.col(error), 2))
    g = e.groupBy(family).agg(F.count("*").alias("n"), F.sum("__sq").alias("__s"))
    top = with_row(g, g.agg(F.sum("__s").alias("__total"))).orderBy(F.col("__s").desc(), F.col(family).asc_nulls_last()).limit(k)
    w = W.orderBy(F.col("__s").desc(), F.col(family).asc_nulls_last())  # k rows
    return top.select(F.row_number().over(w).cast("bigint").alias("place"), family, "n", F.round(F.try_divide("__s", "__total"), 6).alias("share"), F.round(F.try_divide(F.sum("__s").over(w), F.col("__total")), 6).alias("running_share"))


def error_bins(df: DataFrame, value: str, error: str, width: float) -> DataFrame:
    """bin (lower edge), n, share of the squared error by bins of ``value``."""
    e = df.filter(F.col(value).isNotNull()).withColumn("__sq", F.pow(F.col(error), 2)).withColumn("bin", (F.floor(F.col(value) / width) * width).cast("double"))
    g = e.groupBy("bin").agg(F.count("*").alias("n"), F.sum("__sq").alias("__s"))
    return with_row(g, g.agg(F.sum("__s").alias("__total"))).select("bin", "n", F.round(F.try_divide("__s", "__total"), 6).alias("share"))


def compare_runs(runs: dict[str, DataFrame], error: str) -> DataFrame:
    """run, mae, place: saved runs' errors stacked and ranked, ties by name; one row per run."""
    parts = [df.agg(F.avg(F.abs(F.col(error))).alias("mae")).select(F.lit(n).alias("run"), "mae") for n, df in runs.items()]
    w = W.orderBy("mae", "run")  # one row per run
    return reduce(DataFrame.unionByName, parts).select("run", F.round("mae", 4).alias("mae"), F.row_number().over(w).cast("bigint").alias("place"))


def macro_error(df: DataFrame, group: str, error: Column) -> DataFrame:
    """groups, macro_mae (mean of the groups' means), micro_mae (over all rows)."""
    g = df.groupBy(group).agg(F.avg(error).alias("m"), F.sum(error).alias("s"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.round(F.avg("m"), 4).alias("macro_mae"), F.round(F.sum("s") / F.sum("n"), 4).alias("micro_mae"))


def fold_coverage(actual: DataFrame, predicted: DataFrame, key: str, fold: str, folds: int) -> DataFrame:
    """issue, n: rows without a prediction, with several, and of a fold that doesn't exist."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    several = predicted.groupBy(key).count().filter("count > 1")
    return count(actual.join(predicted, key, "left_anti"), "missing").unionByName(count(several, "repeated")).unionByName(count(predicted.filter(F.col(fold).isNull() | ~F.col(fold).between(0, folds - 1)), "bad_fold"))


def review_scores(df: DataFrame, card: str, approach: str, item: str, good: Column, base: str, other: str) -> DataFrame:
    """card, base_good, other_good, delta: a card is good under an approach only if all of its items are; cards
    that only one of the two has are left out."""
    per = df.filter(F.col(approach).isin(base, other)).groupBy(card, approach).agg(F.coalesce(F.bool_and(good), F.lit(False)).cast("int").alias("g"), F.count_distinct(item).alias("items"))
    side = per.groupBy(card).agg(F.max(F.when(F.col(approach) == base, F.col("g"))).alias("base_good"), F.max(F.when(F.col(approach) == other, F.col("g"))).alias("other_good"))
    return side.dropna().withColumn("delta", F.col("other_good") - F.col("base_good"))


def best_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a``, ``b``, jaccard: the best matching cluster of another labeling (ties: the smallest)."""
    c = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    j = c.join(ra, a).join(rb, b).withColumn("j", F.col("n") / (F.col("ra") + F.col("rb") - F.col("n")))
    return j.groupBy(a).agg(F.min_by(b, F.struct((-F.col("j")).alias("j"), F.col(b).alias("v"))).alias(b), F.round(F.max("j"), 9).alias("jaccard"))


def select_fields(df: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """field, coverage, levels, usable: filled enough and with more than one level, in one scan."""
    n = F.count("*")
    one = df.agg(n.alias("n"), *[x for c in columns for x in (F.count(c).alias(f"c_{c}"), F.approx_count_distinct(c).alias(f"l_{c}"))])
    long = one.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c_{c}").alias("__c"), F.col(f"l_{c}").alias("levels")) for c in columns])))
    cover = F.coalesce(F.try_divide("__c", "n"), F.lit(0.0))
    return long.select("field", F.round(cover, 9).alias("coverage"), (F.col("levels") > 1).alias("varies"), ((cover >= least) & (F.col("levels") > 1)).alias("usable"))


def independent_fields(df: DataFrame, columns: list[str], most: float = 0.9, least: float = 0.7) -> list[str]:
    """Usable fields of a block, in order, without those whose rank correlation with an earlier one is above
    ``most``. The loop is over fields."""
    from .metrics import spearman

    usable = [r.field for r in select_fields(df, columns, least).filter("usable").collect()]
    usable = [c for c in columns if c in usable]
    tied = {(r.a, r.b) for r in spearman(df, usable).collect() if r.spearman is not None and abs(r.spearman) > most} if len(usable) > 1 else set()
    kept: list[str] = []
    for c in usable:
        if not any((k, c) in tied for k in kept):
            kept.append(c)
    return kept
