"""Evidence: versions, conflicts, applicability, features per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import n_unique_with_null


def versions(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Distinct payloads per key and whether they conflict (null against a value is a conflict)."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(p).cast("string"), F.lit("\0")) for p in payload])).alias("n_versions"), *[n_unique_with_null(F.col(p)).alias(f"n_{p}") for p in payload])


def conflicting(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    return versions(df, keys, payload).filter("n_versions > 1").select(*keys)


def without_conflicts(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Rows whose key has one version; null keys are a key."""
    bad = conflicting(df, keys, payload).select(*[F.col(k).alias(f"__{k}") for k in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    return df.join(bad, cond, "left_anti")


def applicable(products: Column, year: Column, make: Column, model: Column) -> Column:
    """exact, conflict or unsupported, from an array of structs (type, productYear, productMake,
    productModel): vehicles that match, vehicles that don't, or none named."""
    cars = F.filter(products, lambda p: F.upper(p["type"]) == "VEHICLE")
    hit = F.exists(cars, lambda p: (p["productYear"] == year.cast("string")) & (F.upper(p["productMake"]) == F.upper(make)) & (F.upper(p["productModel"]) == F.upper(model)))
    return F.when(products.isNull() | (F.size(cars) == 0), "unsupported").when(hit, "exact").otherwise("conflict")


def component_counts(df: DataFrame, family: list[str], key: str, components: str) -> DataFrame:
    """Distinct components and records per family, from comma-separated lists."""
    long = df.select(*family, key, F.explode(F.split(components, ",")).alias("__c")).withColumn("__c", F.trim("__c")).filter("__c <> ''")
    return long.groupBy(*family).agg(F.count_distinct("__c").alias("n_components"), F.count_distinct(key).alias("n_records"))


def first_versions(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: each column of the row with the smallest ``order`` (stable, unlike first())."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in columns])


def exposure(filed: Column, year: Column, cutoff: Column, years: int = 4) -> Column:
    """Filed within model year .. model year + ``years`` and not after the cutoff."""
    return F.year(filed).between(year, year + years) & (filed <= cutoff)
