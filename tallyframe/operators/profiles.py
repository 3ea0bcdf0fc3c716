"""Profiles: medians, spreads, modes with agreement, states, reconciliation of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import quantile


def modes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent non-null value per key (ties: the smallest), its count and the observations."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.col(column), F.struct((-F.col("__n")).alias("c"), F.col(column).alias("v"))).alias("mode_value"), F.max("__n").alias("mode_n"), F.sum("__n").alias("observed"))
    return best.withColumn("agreement", F.round(F.col("mode_n") / F.col("observed"), 9))


def agreed(mode: Column, agreement: Column, gate: float = 0.9) -> Column:
    return F.when(agreement >= gate, mode)


def numeric_profile(df: DataFrame, keys: list[str], columns: list[str], error: float = 0.0) -> DataFrame:
    """n, and per column median, IQR (see :func:`quantile` for ``error``), range and observations."""
    cols = [F.count("*").alias("n")]
    for c in columns:
        v = F.col(c)
        cols += [quantile(v, 0.5, error).alias(f"{c}_median"), F.round(quantile(v, 0.75, error) - quantile(v, 0.25, error), 9).alias(f"{c}_iqr"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.count(v).alias(f"{c}_n")]
    return df.groupBy(*keys).agg(*cols)


def label_set(column: str) -> Column:
    """Sorted distinct labels joined by ';' (a closed vocabulary, so the set stays small)."""
    return F.array_join(F.array_sort(F.collect_set(column)), ";")


def parent_state(df: DataFrame, parent: list[str], label: str, weight: str, gate: float = 0.9) -> DataFrame:
    """``parent``, weight, known_labels, assigned_label and state of a parent whose parts carry labels.

    conflicting: a part is labelled so. mixed: there are several labels. assigned: the only label has
    ``gate`` of the whole weight, that of unknown parts included. Otherwise insufficient_evidence. The
    label is given only where it is assigned; null and 'unknown' are unknown.
    """
    name = F.coalesce(F.col(label), F.lit("unknown"))
    by = df.groupBy(*parent, name.alias("__l")).agg(F.sum(weight).alias("__w"))
    known = ~F.col("__l").isin("unknown", "conflicting")
    out = by.groupBy(*parent).agg(
        F.sum("__w").alias("weight"), F.count(F.when(known, 1)).alias("known_labels"), F.max(F.when(known, F.col("__l"))).alias("__label"),
        F.coalesce(F.sum(F.when(known, F.col("__w"))), F.lit(0)).alias("__known"), F.coalesce(F.sum(F.when(F.col("__l") == "conflicting", F.col("__w"))), F.lit(0)).alias("__c"),
    )
    state = F.when(F.col("__c") != 0, "conflicting").when(F.col("known_labels") > 1, "mixed").when((F.col("known_labels") == 1) & (F.try_divide("__known", "weight") >= gate), "assigned").otherwise("insufficient_evidence")
    out = out.withColumn("state", state)
    return out.select(*parent, "weight", "known_labels", F.when(F.col("state") == "assigned", F.col("__label")).alias("assigned_label"), "state")


def reconcile_numeric(first: Column, second: Column, absolute: float, relative: float) -> tuple[Column, Column]:
    """(value, state): the first source where both agree within max(absolute, relative x second)."""
    near = F.abs(first - second) <= F.greatest(F.lit(float(absolute)), F.lit(relative) * second)
    state = F.when(first.isNull() & second.isNull(), "missing").when(second.isNull(), "first_only").when(first.isNull(), "second_only").when(near, "agree").otherwise("conflict")
    return F.when(state == "conflict", None).otherwise(F.coalesce(first, second)), state


def reconcile_label(first: Column, second: Column) -> tuple[Column, Column]:
    state = F.when(first.isNull() & second.isNull(), "missing").when(second.isNull(), "first_only").when(first.isNull(), "second_only").when(first == second, "agree").otherwise("conflict")
    return F.coalesce(first, second), state


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str, least: int) -> DataFrame:
    """Mean of the inner groups' means per outer group with at least ``least`` inner groups."""
    per = df.groupBy(outer, inner).agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    return per.groupBy(outer).agg(F.round(F.avg("__m"), 9).alias("mean_of_means"), F.count("*").alias("inner_groups"), F.sum("__n").alias("n_rows")).filter(F.col("inner_groups") >= least)


def running_share(df: DataFrame, order: list, weight: str, out: str = "running_share", most: int = 100_000) -> DataFrame:
    """Cumulative share of ``weight``. For results of an aggregation: one global order of at most ``most`` rows,
    which is checked (an error beyond)."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to order in one task")
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.round(F.sum(weight).over(w) / F.sum(weight).over(W.partitionBy()), 9))
