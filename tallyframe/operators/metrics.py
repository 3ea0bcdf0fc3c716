"""Error metrics, segments, agreement and association measures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import quantile, with_row


def regression(actual: str, predicted: str, digits: int = 6, error: float = 0.0) -> list[Column]:
    """Aggregates n, mae, rmse, r2 (null for one row or constant actuals), wape_pct (of the sum of actuals;
    null unless that is positive), bias, p95_error (see :func:`quantile` for ``error``)."""
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    sse, spread = F.sum(e * e), F.var_pop(a) * F.count("*")
    return [
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), digits).alias("mae"), F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        F.round(F.when(spread > 0, 1 - sse / spread), digits).alias("r2"),
        F.round(F.when(F.sum(a) > 0, F.lit(100.0) * F.sum(F.abs(e)) / F.sum(a)), digits).alias("wape_pct"),
        F.round(F.avg(e), digits).alias("bias"), F.round(quantile(F.abs(e), 0.95, error), digits).alias("p95_error"),
    ]


def segmented(df: DataFrame, dimensions: list[str], aggs: list[Column]) -> DataFrame:
    """dimension, segment and the aggregates: each dimension alone, from one scan. Null is a segment."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("s")) for d in dimensions])).alias("__dimension__"))
    return long.groupBy(F.col("__dimension__.d").alias("dimension"), F.col("__dimension__.s").alias("segment")).agg(*aggs)


def grouped_sets(df: DataFrame, a: str, b: str, aggs: list[Column]) -> DataFrame:
    """By a, by b and by both; level tells which (1: a, 2: b, 0: both)."""
    out = df.groupingSets([[F.col(a)], [F.col(b)], [F.col(a), F.col(b)]], F.col(a), F.col(b)).agg(F.grouping_id().cast("bigint").alias("level"), *aggs)
    return out


def confusion(truth: str, guess: str) -> list[Column]:
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = lambda c: F.count(F.when(c, 1))
    tp, fp, fn, tn = n(t & g), n(~t & g), n(t & ~g), n(~t & ~g)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(F.try_divide(tp, tp + fn), 9).alias("recall"), F.round(F.try_divide(tp, tp + fp), 9).alias("precision")]


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval within 0 and 1; without observations all of it."""
    p = F.try_divide(hits, n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), high)).otherwise(1.0)


def wilson_gate(hits: Column, n: Column, point: float, lower: float, least: int = 30) -> Column:
    """Enough observations, a share of at least ``point`` and its Wilson lower end at least ``lower``."""
    return (n >= least) & (hits / F.greatest(n, F.lit(1)) >= point) & (wilson(hits, n)[0] >= lower)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2, v with the bias correction. Runs over the contingency table."""
    t = contingency(df, a, b)
    t = t.withColumn("ra", F.sum("n").over(W.partitionBy(a))).withColumn("rb", F.sum("n").over(W.partitionBy(b)))
    s = t.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("q"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"))
    n = F.col("total").cast("double")
    phi = F.col("q") - 1
    fix = F.greatest(F.lit(0.0), phi - (F.col("r") - 1) * (F.col("k") - 1) / (n - 1))
    rc, kc = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / (n - 1), F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (n - 1)
    return s.select(F.col("total").alias("n"), F.round(phi * n, 4).alias("chi2"), F.round(F.sqrt(fix / F.least(rc - 1, kc - 1)), 9).alias("cramers_v"))


def eta_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """Correlation ratio of a value on a category, nulls left out."""
    per = df.filter(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    tot = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / tot
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - tot * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    return per.agg(tot.alias("n"), F.round(F.sqrt(between / (between + within)), 6).alias("eta"))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation of the rows that have both; null without any or where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation and overlap of every pair of columns, pairwise complete, in one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cols = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        cols += [pearson(F.col(a), F.col(b)).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    one = df.agg(*cols)
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("overlap"), F.round(f"r{i}", 6).alias("pearson")) for i, (a, b) in enumerate(pairs)])))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency table's pair counts."""
    t = contingency(df, a, b)
    two = lambda c: c * (c - 1) / 2.0
    cell = t.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ra = t.groupBy(a).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("i"))
    rb = t.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("j"))
    s = with_row(with_row(cell, ra), rb)
    expected = F.col("i") * F.col("j") / two(F.col("n"))
    top = (F.col("i") + F.col("j")) / 2.0
    return s.select(F.col("n").alias("n"), F.round(F.when(top != expected, (F.col("ij") - expected) / (top - expected)).otherwise(1.0), 9).alias("ari"))


def adjust_p(df: DataFrame, p: str, out: str = "q", tie: tuple[str, ...] = (), most: int = 100_000) -> DataFrame:
    """Benjamini-Hochberg values; ties by ``tie``. For a table of tests: one global order of at most ``most``
    rows, which is checked (an error beyond). Null p-values have none."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} tests to order in one task")
    known, order = F.col(p).isNotNull(), [F.col(p).asc_nulls_last(), *[F.col(c) for c in tie]]
    raw = df.withColumn("__q", F.when(known, F.col(p) * F.count(p).over(W.partitionBy()) / F.row_number().over(W.orderBy(*order))))
    back = W.orderBy(F.col(p).desc_nulls_first(), *[F.col(c).desc() for c in tie]).rowsBetween(W.unboundedPreceding, W.currentRow)
    return raw.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("__q").over(back)))).drop("__q")


def poisson_count(u: Column, most: int = 12) -> Column:
    """Poisson number of mean 1 from a uniform number in [0, 1); above ``most`` lies less than 1e-9."""
    total, out = 0.0, F.lit(0)
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u >= total).cast("int")
    return out


def _draws(per: DataFrame, block: str, draws: int, seed: str) -> DataFrame:
    """Each block once per draw with ``__k``, how often it is drawn: a Poisson number from its hash, so that
    no block is moved and draws need nothing of each other."""
    long = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", F.col(block)), F.lit(1 << 40).cast("bigint")) / float(1 << 40)
    return long.withColumn("__k", poisson_count(u))


def bootstrap_means(df: DataFrame, block: str, value: str, draws: int, seed: str = "boot") -> DataFrame:
    """Block bootstrap: draw, mean. Blocks are reduced to sums before they are drawn; a draw without any
    block has a null mean."""
    per = df.groupBy(block).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return _draws(per, block, draws, seed).groupBy("draw").agg(F.try_divide(F.sum(F.col("__s") * F.col("__k")), F.sum(F.col("__n") * F.col("__k"))).alias("mean"))


def paired_bootstrap(df: DataFrame, block: str, segment: list[str], first: str, second: str, draws: int = 2000, seeds: tuple[str, ...] = ("a", "b"), level: float = 0.95) -> DataFrame:
    """``segment``, seed, n, delta, low, high, decided: mean of second - first over rows that have both, with
    the ends of its bootstrap interval over blocks; decided where the interval leaves out 0. Two seeds tell
    whether the ends are stable."""
    pairs = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    per = pairs.groupBy(*segment, block).agg(F.sum(F.col(second) - F.col(first)).alias("__s"), F.count("*").alias("__n"))
    whole = per.groupBy(*segment).agg(F.sum("__n").alias("n"), (F.sum("__s") / F.sum("__n")).alias("delta"))
    parts = []
    for seed in seeds:
        means = _draws(per, block, draws, seed).groupBy(*segment, "draw").agg(F.try_divide(F.sum(F.col("__s") * F.col("__k")), F.sum(F.col("__n") * F.col("__k"))).alias("m"))
        ends = means.groupBy(*segment).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))  # ``draws`` values each
        parts.append(ends.withColumn("seed", F.lit(seed)))
    ends = reduce(DataFrame.unionByName, parts)
    out = whole.join(ends, segment) if segment else with_row(ends, whole)
    return out.select(*segment, "seed", "n", "delta", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("decided"))


def mean_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the mean rank of ``column`` among all rows that have one (ties share it).

    Values are counted first; ranks are running sums over the different values, formed bucket by bucket of
    the value's range, so no task sorts the whole column however many different values it has.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / 64 for i in range(1, 64)], 10000)).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("__b", F.size(F.filter(edges, lambda e: e < F.col("__v").cast("double"))))
    before = {r["__b"]: r.n for r in counts.groupBy("__b").agg(F.sum("__n").alias("n")).collect()}  # at most 64 buckets
    total, offsets = 0, {}
    for b in sorted(before):
        offsets[b] = total
        total += before[b]
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("__b")) if offsets else F.lit(0)
    w = W.partitionBy("__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = counts.withColumn(out, base + F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0).select("__v", out)
    return df.join(ranks, df[column] == ranks["__v"], "left").drop("__v")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, overlap, spearman of every pair of columns, pairwise complete: Pearson correlation of mean ranks
    among the rows that have both. Null where a column is constant."""
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
            ranked = mean_ranks(mean_ranks(both, "a", "ra"), "b", "rb")
            parts.append(ranked.agg(F.count("*").alias("overlap"), F.round(pearson(F.col("ra"), F.col("rb")), 6).alias("spearman")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "overlap", "spearman"))
    return reduce(DataFrame.unionByName, parts)


def modal_accuracy(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, correct, accuracy of guessing b from a by a's most frequent b."""
    t = contingency(df, a, b).groupBy(a).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return t.agg(F.sum("n").alias("n"), F.sum("top").alias("correct"), F.round(F.try_divide(F.sum("top"), F.sum("n")), 9).alias("accuracy"))


def condition_indices(df: DataFrame, columns: list[str]) -> list[float]:
    """Square roots of the largest eigenvalue of the correlation matrix over each, ascending."""
    import numpy as np

    values = np.linalg.eigvalsh(_correlation_matrix(df, columns))
    return sorted(float(np.sqrt(values[-1] / max(v, 1e-15))) for v in values)


def inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix, which is
    columns x columns and comes from one aggregation."""
    import numpy as np

    return dict(zip(columns, np.diag(np.linalg.inv(_correlation_matrix(df, columns))).tolist()))


def _correlation_matrix(df: DataFrame, columns: list[str]):
    import numpy as np

    n = len(columns)
    cells = df.dropna(subset=columns).agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first()
    m = np.eye(n)
    for i in range(n):
        for j in range(i + 1, n):
            m[i, j] = m[j, i] = cells[f"r{i}_{j}"]
    return m
