"""Percentiles of very large numeric columns by radix selection.

Doubles are mapped to order-preserving integers; histograms of successive bit digits are counted
per group, and only the digit that holds each target rank is followed. One level of histogram is a
mergeable summary with a stated relative error; all levels give the exact value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..sources.shared import materialise


@F.pandas_udf(T.LongType())
def _to_bits(v: pd.Series) -> pd.Series:
    raw = (v.to_numpy("float64") + 0.0).view("int64")  # + 0.0 makes -0.0 the same as 0.0
    return pd.Series(np.where(raw < 0, -(raw & _MAGNITUDE), raw))


@F.pandas_udf(T.DoubleType())
def _from_bits(b: pd.Series) -> pd.Series:
    raw = b.to_numpy("int64")
    return pd.Series(np.where(raw < 0, -np.abs(raw).view("float64"), raw.view("float64")))


_MAGNITUDE = np.int64(2**63 - 1)


def ordered_bits(value: Column) -> Column:
    """bigint whose signed order is that of a finite double: its IEEE-754 layout, with negative
    numbers mirrored. A view of the Arrow buffer, without a step per value. -0.0 equals 0.0."""
    return _to_bits(value.cast("double"))


def bits_value(bits: Column) -> Column:
    """The double that :func:`ordered_bits` maps to ``bits``."""
    return _from_bits(bits.cast("bigint"))


def _long(df: DataFrame, groups: list[str], columns: list[str]) -> tuple[DataFrame, list[str]]:
    """(__g*, metric, bits): one row per finite value of a column."""
    g = [f"__g{i}" for i in range(len(groups))]
    base = df.select(*[F.col(c).alias(n) for c, n in zip(groups, g)], F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("__x"))
    base = base.select(*g, F.col("__x.metric").alias("metric"), F.col("__x.value").alias("__value")).filter("__value IS NOT NULL AND NOT isnan(__value) AND abs(__value) <> double('infinity')")
    return base.select(*g, "metric", ordered_bits(F.col("__value")).alias("bits")), g


def radix_histogram(df: DataFrame, groups: list[str], columns: list[str], bits: int = 20) -> DataFrame:
    """Mergeable summary: ``groups``, metric, digit (the leading ``bits`` of the ordered value), n.

    Values in a digit share sign, exponent and bits - 12 bits of fraction, so a percentile read from
    the merged counts is off by less than 2 ** (12 - bits) of the value. Its size is bounded by the
    digits in use, not by the rows. Nulls, NaN and infinities aren't counted; null group keys are a
    group. Counting combines before the shuffle, so a hot group costs one row per digit and task.
    """
    clash = {"metric", "digit", "n"} & set(groups)
    if clash:
        raise ValueError(f"group columns clash with result columns: {sorted(clash)}")
    rows, g = _long(df, groups, columns)
    h = rows.groupBy(*g, "metric", F.shiftright("bits", 64 - bits).alias("digit")).agg(F.count("*").alias("n"))
    return h.select(*[F.col(n).alias(c) for n, c in zip(g, groups)], "metric", "digit", "n")


def merge_histograms(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Sum of summaries of separate slices: the summary of their union."""
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "metric", "digit").agg(F.sum("n").alias("n"))


def _rank(n: Column, p: Column) -> Column:
    """1-based nearest rank of the p-quantile among n values."""
    return F.greatest(F.lit(1), n - F.floor(n - p * n)).cast("bigint")


def _holds_rank(df: DataFrame) -> DataFrame:
    return df.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))


def _locate(hist: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """Of a first histogram: the digit holding each target rank, with total, p, rank and upto."""
    w = W.partitionBy(*by).orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    cum = cum.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps]))).withColumn("rank", _rank(F.col("total"), F.col("p")))
    return _holds_rank(cum)


def histogram_percentiles(hist: DataFrame, groups: list[str], ps: list[float], bits: int = 20) -> DataFrame:
    """``groups``, metric, p, n_values, lower, upper: the percentile lies in [lower, upper]."""
    found = _locate(hist, [*groups, "metric"], ps)
    low = F.shiftleft(F.col("digit"), 64 - bits)
    high = low + F.lit(2 ** (64 - bits) - 1)
    top = 0x7FEFFFFFFFFFFFFF
    return found.select(*groups, "metric", "p", F.col("total").alias("n_values"), bits_value(F.greatest(low, F.lit(-top))).alias("lower"), bits_value(F.least(high, F.lit(top))).alias("upper"))


def radix_percentiles(df: DataFrame, groups: list[str], columns: list[str], ps: list[float], digit_bits: int = 16) -> DataFrame:
    """Exact nearest-rank percentiles: ``groups``, metric, p, n_values, value.

    The ordered integers are written once, with their groups; 64 / ``digit_bits`` passes read them. Each pass
    counts one digit per group with
    map-side combine and keeps only rows under the prefixes that still hold a target; prefixes are a
    table of groups x percentiles that is joined on group and prefix, so a hot group spreads over its
    prefixes. It is written to the shared folder after each pass. Groups without a finite value have
    no row.
    """
    clash = {"metric", "p", "n_values", "value"} & set(groups)
    if clash:
        raise ValueError(f"group columns clash with result columns: {sorted(clash)}")
    rows, g = _long(df, groups, columns)
    # null keys as a flag and a filler, so that joins on the group are plain equalities
    keys = []
    for c in g:
        rows = rows.withColumn(f"{c}n", F.col(c).isNull())
        keys += [c, f"{c}n"]
    kinds = {c: rows.schema[c].dataType for c in g}
    for c in g:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("" if kinds[c].simpleString() == "string" else "0").cast(kinds[c])))
    by = [*keys, "metric"]
    rows = materialise(rows, "bits")
    wanted = None
    for step in range(64 // digit_bits):
        shift = 64 - digit_bits * (step + 1)
        level = rows.withColumn("digit", F.shiftright("bits", shift) if shift else F.col("bits"))
        if wanted is None:
            hist = level.groupBy(*by, "digit").agg(F.count("*").alias("n"))
            found = _locate(hist, by, ps)
        else:
            under = wanted.select(*by, "prefix").distinct()
            kept = level.withColumn("prefix", F.shiftright("digit", digit_bits)).join(under, [*by, "prefix"], "left_semi")
            hist = kept.groupBy(*by, "prefix", "digit").agg(F.count("*").alias("n"))
            w = W.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)
            cum = hist.withColumn("upto", F.sum("n").over(w))
            found = _holds_rank(cum.join(wanted, [*by, "prefix"]))
        nxt = found.select(*by, "p", "total", F.col("digit").alias("prefix"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
        wanted = materialise(nxt, "radix") if shift else nxt
    return wanted.select(*[F.when(~F.col(f"{c}n"), F.col(c)).alias(o) for c, o in zip(g, groups)], "metric", "p", F.col("total").alias("n_values"), bits_value(F.col("prefix")).alias("value"))
