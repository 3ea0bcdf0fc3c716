"""Invariant checks as queries: each yields its number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(name: str, df: DataFrame) -> DataFrame:
    """check_name, violations, status for the rows of ``df`` (each a violation)."""
    n = df.agg(F.count("*").alias("violations"))
    return n.select(F.lit(name).alias("check_name"), "violations", F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [violations(n, d) for n, d in checks.items()])


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).between(low, high))


def same_population(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side only."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    return x.join(y, on, "left_anti").unionByName(y.join(x, on, "left_anti"))


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) of one frame only: equal frames give none, whatever their order."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent digest of a frame: row count, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum((h % 1_000_000_007).cast("decimal(38,0)")).cast("string").alias("sum_hash"))
