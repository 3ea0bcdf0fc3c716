"""Cleaning: schema discovery of JSON, expansion, pivots, profiles of columns, loss accounting."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """key, n, kind: every top-level key of JSON objects, rows holding it and its type (the widest of
    bool, int, float, text over all rows)."""
    pairs = df.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "raw"))
    raw = F.trim("raw")
    rank = F.when(F.col("raw").isNull(), 0).when(raw.isin("true", "false"), 1).when(raw.rlike(r"^-?\d+$"), 2).when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), 3).otherwise(4)
    agg = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max(rank).alias("__hi"), F.min(F.when(rank > 0, rank)).alias("__lo"))
    kind = F.when(F.col("__hi") == 0, "null").when((F.col("__lo") == 1) & (F.col("__hi") > 1), "text").when(F.col("__hi") == 1, "bool").when(F.col("__hi") == 2, "int").when(F.col("__hi") == 3, "float").otherwise("text")
    return agg.select("key", "n", kind.alias("kind"))


_KINDS = {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "text": "string"}


def expand_json(df: DataFrame, column: str, keys: dict[str, str], prefix: str = "json_") -> DataFrame:
    """One column per key, typed; a name already taken gets the prefix (twice, if need be). ``keys``
    is what one discovery job returned, so the plan itself stays pure."""
    out = df.withColumn("__m", F.from_json(F.col(column), "map<string,string>"))
    for k in sorted(keys):
        name = k
        while name in df.columns or name.lower() in {c.lower() for c in out.columns}:
            name = prefix + name
        out = out.withColumn(name, F.try_element_at("__m", F.lit(k)).try_cast(_KINDS[keys[k]]))
    return out.drop("__m", column)


def pivot_long(df: DataFrame, keys: list[str], field: str, value: str, fields: list[str]) -> DataFrame:
    """Long to wide by conditional maximum. Two fields that differ by case only are an error."""
    low = [f.lower() for f in fields]
    if len(set(low)) < len(low):
        raise ValueError("field names collide without regard to case")
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def convert_if_representable(df: DataFrame, column: str, converted: Column) -> DataFrame:
    """The converted column if no non-null value is lost anywhere in it, else the column as it was."""
    lost = df.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "") & converted.isNull()).limit(1).count()
    return df if lost else df.withColumn(column, converted)


def new_nulls(df: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """column, nulls_before, nulls_after, new_nulls of converted columns, in one aggregation."""
    one = df.agg(*[F.count(F.when(c.isNull(), 1)).alias(f"b_{n}") for n, c in before.items()], *[F.count(F.when(after[n].isNull(), 1)).alias(f"a_{n}") for n in before])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"b_{n}").alias("nulls_before"), F.col(f"a_{n}").alias("nulls_after"), (F.col(f"a_{n}") - F.col(f"b_{n}")).alias("new_nulls")) for n in before])))


def missing(df: DataFrame, column: str) -> Column:
    """Null, blank text or NaN."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, missing, distinct_values of each column, from one scan."""
    cols = [F.count("*").alias("__n")]
    for c in columns:
        m = missing(df, c)
        cols += [F.count(F.when(m, 1)).alias(f"m_{c}"), F.count_distinct(F.when(~m, F.col(c))).alias(f"d_{c}")]
    one = df.agg(*cols)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])))


def rarity(df: DataFrame, columns: list[str], rare: int) -> DataFrame:
    """column_name, raw_levels, levels (normalised), rare_levels (<= ``rare`` rows), rare_rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("__x")).select(F.col("__x.c").alias("column_name"), F.col("__x.v").alias("raw")).filter("raw IS NOT NULL AND trim(raw) <> ''")
    raw = long.groupBy("column_name", "raw").agg(F.count("*").alias("n")).withColumn("level", F.upper(F.regexp_replace(F.trim("raw"), r"\s+", " ")))
    level = raw.groupBy("column_name", "level").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
    return level.groupBy("column_name").agg(F.sum("spellings").alias("raw_levels"), F.count("*").alias("levels"), F.count(F.when(F.col("n") <= rare, 1)).alias("rare_levels"), F.coalesce(F.sum(F.when(F.col("n") <= rare, F.col("n"))), F.lit(0)).alias("rare_rows"))


def key_quality(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys, repeated keys, rows of repeated keys, largest repeat."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_affected"), F.max("n").alias("largest"))


@F.pandas_udf(T.StringType())
def strict_json_error(text: pd.Series) -> pd.Series:
    """Why a text isn't a strict JSON object (repeated keys, NaN constants, not an object), or null."""

    def check(t):
        if t is None:
            return "missing"

        def pairs(items):
            keys = [k for k, _ in items]
            if len(set(keys)) < len(keys):
                raise ValueError("repeated key")
            return dict(items)

        def constant(name):
            raise ValueError("constant " + name)

        try:
            value = json.loads(t, object_pairs_hook=pairs, parse_constant=constant)
        except (ValueError, RecursionError) as e:
            return str(e) if str(e).startswith(("repeated", "constant")) else "not JSON"
        return None if isinstance(value, dict) else "not an object"

    return text.map(check)


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns without a name prefix; a name that would be taken twice is an error."""
    names = {c: c.removeprefix(prefix) for c in df.columns}
    if len({n.lower() for n in names.values()}) < len(names):
        raise ValueError(f"names collide without the prefix {prefix!r}")
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def select_policy(df: DataFrame, wanted: list[str], require_all: bool = True) -> DataFrame:
    """The wanted columns in order; missing ones are an error, or null text columns."""
    lacking = [c for c in wanted if c not in df.columns]
    if lacking and require_all:
        raise ValueError(f"missing columns: {lacking}")
    return df.select(*[F.col(c) if c not in lacking else F.lit(None).cast("string").alias(c) for c in wanted])
