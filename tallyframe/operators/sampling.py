"""Deterministic splits, folds, quotas and samples by salted hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import sha_hex


def split_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """Adds the rank of every row in its group (and the group's size), without sorting a group in one
    task: rows are ranked inside (group, bucket), and the sizes of the group's earlier buckets are
    added. ``bucket`` must not fall as the order rises and take few values (some hundreds)."""
    keyed = df.withColumn("__b", bucket)
    sizes = keyed.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__b").alias("__gb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(*group)).alias("__all"))
    ranked = keyed.withColumn("__in", F.row_number().over(W.partitionBy(*group, "__b").orderBy(*order)))
    on = F.col("__b") == F.col("__gb")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = ranked.join(sizes, on).withColumn(out, (F.col("__in") + F.col("__before")).cast("bigint"))
    if total:
        joined = joined.withColumn(total, F.col("__all"))
    return joined.drop("__b", "__in", "__before", "__all", "__gb", *[f"__g{i}" for i in range(len(group))])


def hash_rank(df: DataFrame, strata: list[str], key: str, salt: str, out: str = "__r", total: str | None = "__n") -> DataFrame:
    """Rank by salted hash in each stratum; the hash's first digits are the buckets."""
    h = df.withColumn("__h", sha_hex(key, salt=salt))
    return split_rank(h, strata, F.substring("__h", 1, 2), [F.col("__h"), F.col(key)], out, total).drop("__h")


def stratified_split(df: DataFrame, strata: list[str], key: str, least: int = 25, salt: str = "42") -> DataFrame:
    """fit / validation / test by hash order in each stratum (a fifth each to test and validation,
    rounded down); strata with fewer than ``least`` rows are excluded. Null is a stratum."""
    ranked = hash_rank(df, strata, key, salt)
    fifth = F.floor(F.col("__n") / 5)
    split = F.when(F.col("__n") < least, "excluded").when(F.col("__r") <= fifth, "test").when(F.col("__r") <= 2 * fifth, "validation").otherwise("fit")
    return ranked.withColumn("split", split).drop("__r", "__n")


def folds(df: DataFrame, strata: list[str], key: str, k: int, salt: str = "42") -> DataFrame:
    """Folds 0..k-1 in turn by hash order within each stratum."""
    return hash_rank(df, strata, key, salt).withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("bigint")).drop("__r", "__n")


def inner_split(df: DataFrame, strata: list[str], key: str, salt: str = "7") -> DataFrame:
    """Marks max(1, a fifth) of each stratum as inner validation."""
    return hash_rank(df, strata, key, salt).withColumn("inner_validation", F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 5))).drop("__r", "__n")


def quotas(df: DataFrame, group: list[str], total: int, least: int) -> DataFrame:
    """Rows to take per group: ``least`` each (or all it has), the rest in proportion to what is left,
    whole numbers by largest remainder. The windows run over groups, not rows."""
    g = df.groupBy(*group).agg(F.count("*").alias("n"))
    allw = W.partitionBy()
    g = g.withColumn("base", F.least(F.col("n"), F.lit(least))).withColumn("left", F.col("n") - F.col("base"))
    g = g.withColumn("pool", F.greatest(F.lit(0), F.lit(total) - F.sum("base").over(allw))).withColumn("all_left", F.sum("left").over(allw))
    g = g.withColumn("ideal", F.when(F.col("all_left") > 0, F.least(F.col("left").cast("double"), F.col("pool") * F.col("left") / F.col("all_left"))).otherwise(0.0))
    g = g.withColumn("whole", F.floor("ideal")).withColumn("rest", F.col("pool") - F.sum("whole").over(allw))
    order = W.orderBy((F.col("ideal") - F.col("whole")).desc(), *[F.col(c) for c in group])
    more = ((F.row_number().over(order) <= F.col("rest")) & (F.col("whole") < F.col("left"))).cast("bigint")
    return g.select(*group, "n", (F.col("base") + F.col("whole") + more).cast("bigint").alias("quota"))


def quota_sample(df: DataFrame, group: list[str], key: str, total: int, least: int, salt: str = "42") -> DataFrame:
    q = quotas(df, group, total, least).drop("n")
    return hash_rank(df.join(q, group), group, key, salt, total=None).filter(F.col("__r") <= F.col("quota")).drop("__r", "quota")


def round_robin_sample(df: DataFrame, strata: list[str], key: str, k: int, salt: str = "42", cap: int | None = None) -> DataFrame:
    """One row of each stratum in turn until k; ``cap`` rows of a stratum at most, where the cap is
    the rule wanted."""
    w = W.partitionBy(*strata).orderBy(sha_hex(key, salt=salt), key)
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= min(cap or k, k))  # no stratum gives more than k: cut before the shuffle
    r = top.withColumn("__h", sha_hex(key, salt=salt))
    return r.orderBy("__r", "__h", key).limit(k).drop("__r", "__h")


def group_split(df: DataFrame, group: str, shares: dict[str, float], salt: str = "42") -> DataFrame:
    """Whole groups to splits by a hash threshold; no shuffle."""
    u = F.conv(F.substring(sha_hex(group, salt=salt), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def first_owner(df: DataFrame, same: str, owner: str, order: list[str]) -> DataFrame:
    """The owner (split, source) that a repeated text belongs to: that of its first row."""
    who = df.groupBy(same).agg(F.min_by(owner, F.struct(*order)).alias("first_owner"))
    return df.join(who, same)
