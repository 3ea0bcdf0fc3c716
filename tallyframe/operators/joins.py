"""Joins with a stated cardinality, fills, fallbacks, ranges, prefixes and snapshot diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join side has repeated keys where the stated cardinality allows one."""


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more than one row, nulls left out (they never join)."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).groupBy(*on).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "m:1", strict: bool = False) -> DataFrame:
    """Join whose "1" sides must have unique keys.

    ``strict`` runs the uniqueness test now and raises :class:`CardinalityError`. Otherwise the test
    travels with the plan: the right side is aggregated per key and the query fails on the first
    repeated key it joins, without a job of its own.
    """
    sides = cardinality.split(":")
    if strict:
        for side, df, name in ((sides[0], left, "left"), (sides[1], right, "right")):
            if side == "1" and duplicate_keys(df, on).limit(1).count():
                raise CardinalityError(f"{name} side has repeated keys in {on}")
        return left.join(right, on, how)
    if sides[1] == "1":
        rest = [c for c in right.columns if c not in on]
        unique = right.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rest])
        right = unique.filter(F.assert_true(F.col("__n") == 1, F.lit(f"repeated keys in {on}")).isNull()).drop("__n")
    return left.join(right, on, how)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def aligned_fill(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Exactly the key population: rows outside it dropped, missing keys filled with nulls."""
    return keys.select(*on).distinct().join(rows, on, "left")


def fallback_join(left: DataFrame, fine: DataFrame, coarse: DataFrame, fine_on: list[str], coarse_on: list[str], value: str, labels: tuple[str, str, str] = ("fine", "coarse", "missing")) -> DataFrame:
    """Value of the fine level, else of the coarse level, with its provenance in ``{value}_level``."""
    a = fine.select(*fine_on, F.col(value).alias("__a"), F.lit(True).alias("__ha"))
    b = coarse.select(*coarse_on, F.col(value).alias("__b"), F.lit(True).alias("__hb"))
    j = left.join(a, fine_on, "left").join(b, coarse_on, "left")
    level = F.when(F.col("__ha"), labels[0]).when(F.col("__hb"), labels[1]).otherwise(labels[2])
    return j.withColumn(value, F.when(F.col("__ha"), F.col("__a")).when(F.col("__hb"), F.col("__b"))).withColumn(f"{value}_level", level).drop("__a", "__b", "__ha", "__hb")


def range_join(left: DataFrame, ranges: DataFrame, on: list[str], point: str, low: str, high: str, how: str = "left", bucket: float | None = None) -> DataFrame:
    """Rows with ``low <= point <= high`` and equal ``on``. With ``bucket``, both sides get the
    range's buckets as one more equality, for keys too coarse to split the work."""
    if bucket is None:
        cond = reduce(lambda a, b: a & b, [left[c] == ranges[c] for c in on] + [left[point].between(ranges[low], ranges[high])])
        joined = left.join(ranges, cond, how)
        for c in on:
            joined = joined.drop(ranges[c])
        return joined
    lb = left.withColumn("__b", F.floor(F.col(point) / bucket))
    rb = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    cond = reduce(lambda a, b: a & b, [lb[c] == rb[c] for c in on] + [lb["__b"] == rb["__b"], lb[point].between(rb[low], rb[high])])
    joined = lb.join(rb, cond, how)
    for c in [*on, "__b"]:
        joined = joined.drop(rb[c])
    return joined.drop("__b")


def prefix_join(left: DataFrame, prefixes: DataFrame, on: list[str], text: str, prefix: str) -> DataFrame:
    """Each left row with every prefix (equal to its text, or followed by a blank in it) within equal ``on``.

    A row lists the beginnings of its text that end before a blank, so the join is an equality on ``on`` and the
    beginning: a hot ``on`` value is split by them instead of meeting all of its prefixes. Null texts and
    keys have none; repeated prefixes count once.
    """
    words = F.split(F.col(text), " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return left.withColumn(prefix, F.explode(begins)).join(prefixes.select(*on, prefix).distinct(), [*on, prefix])


def longest_prefix_join(left: DataFrame, prefixes: DataFrame, on: list[str], text: str, prefix: str, key: list[str]) -> DataFrame:
    """Each left row with ``matched_prefix``, its longest prefix (see :func:`prefix_join`); null where none fits.
    Two different prefixes of one length can't both fit."""
    hits = prefix_join(left.select(*dict.fromkeys([*key, *on, text])), prefixes, on, text, prefix)
    best = hits.groupBy(*key).agg(F.max_by(prefix, F.length(prefix)).alias("matched_prefix"))
    return left.join(best, key, "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``key`` and change (added, removed, changed); values compare null-safe."""
    a = old.select(*key, *[F.col(v).alias(f"__o_{v}") for v in values], F.lit(True).alias("__old"))
    b = new.select(*key, *[F.col(v).alias(f"__n_{v}") for v in values], F.lit(True).alias("__new"))
    j = a.join(b, key, "full")
    same = reduce(lambda x, y: x & y, [F.col(f"__o_{v}").eqNullSafe(F.col(f"__n_{v}")) for v in values])
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "changed")
    return j.select(*key, change.alias("change")).filter("change IS NOT NULL")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], recency: str, merge_null: bool = False) -> DataFrame:
    """Newest row per key (incoming wins a tie); with ``merge_null`` a null field keeps the older value."""
    both = current.withColumn("__src", F.lit(0)).unionByName(incoming.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "__src"]
    order = F.struct(F.col(recency), F.col("__src"))
    if merge_null:
        cols = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    else:
        cols = [F.max_by(F.struct(*rest), order).alias("__r")]
    out = both.groupBy(*key).agg(*cols)
    return out if merge_null else out.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null, differing types become text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    cast = [c for c, t in kinds.items() if len(t) > 1]
    fixed = [f.withColumns({c: F.col(c).cast("string") for c in cast if c in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)
