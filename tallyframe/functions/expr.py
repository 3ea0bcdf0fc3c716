"""Column helpers shared by the operators: binding, tolerant parsing, keys, hashes, null rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once however often the body names it.

    Without this, an expression built from a reused sub-expression grows with every use and the
    generated code outgrows the JVM's method size.
    """
    return F.get(F.transform(F.array(value), body), 0)


def finite(col: Column) -> Column:
    """A double, with NaN and the infinities as null."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def parse_double(col: Column, unit: str | None = None) -> Column:
    """Tolerant double: an optional unit ending is dropped; blank, unreadable or non-finite is null."""
    t = F.trim(F.regexp_replace(col, rf"\s*{unit}\s*$", "")) if unit else F.trim(col)
    return finite(F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))


def parse_int(col: Column) -> Column:
    """Tolerant bigint: plain decimals only, one fractional digit kept, halves away from zero."""
    t = F.trim(col)
    ok = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    cut = F.regexp_replace(t, r"(\.\d)\d*$", "$1")
    return F.when(ok, F.round(cut.try_cast("decimal(38,1)"), 0).try_cast("bigint"))


def norm_key(col: Column) -> Column:
    """Trimmed, upper case, runs of white space as one blank."""
    return F.upper(F.regexp_replace(F.trim(col), r"\s+", " "))


UNKNOWN = ("", "UNKNOWN", "NOT APPLICABLE", "N/A", "--")  # fixed values


def canonical(col: Column) -> Column:
    """:func:`norm_key` with the unknown markers as null."""
    k = norm_key(col)
    return F.when(~k.isin(*UNKNOWN), k)


def holds(pred: Column) -> Column:
    """Three-valued predicate with unknown as false."""
    return F.coalesce(pred, F.lit(False))


def sha_hex(*cols: Column | str, salt: str = "") -> Column:
    """SHA-256 hex of ``salt|col|col...``; nulls count as empty text."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def hash_mod(col: Column | str, k: int, salt: str = "42") -> Column:
    """Bucket 0..k-1 from the first 15 hex digits of the salted SHA-256 (portable across engines)."""
    return F.pmod(F.conv(F.substring(sha_hex(col, salt=salt), 1, 15), 16, 10).cast("bigint"), F.lit(k)).cast("bigint")


def hash_unit(col: Column | str, salt: str = "42") -> Column:
    """Number in [0, 1) from the salted SHA-256."""
    return F.conv(F.substring(sha_hex(col, salt=salt), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def n_unique_with_null(col: Column) -> Column:
    """Distinct values, with null as one of them."""
    return (F.count_distinct(col) + F.coalesce(F.max(F.when(col.isNull(), 1).otherwise(0)), F.lit(0))).cast("bigint")


def suppress(value: Column, *enough: Column) -> Column:
    """The value where every support condition holds, else null."""
    ok = F.lit(True)
    for c in enough:
        ok = ok & holds(c)
    return F.when(ok, value)


def left_closed_band(col: Column, width: float) -> Column:
    """Lower edge of the left-closed band of ``width`` that holds the value."""
    return (F.floor(col / width) * width).cast("double")


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as a scalar subquery (no join)."""
    packed = df.withColumn("__one", one.select(F.struct(*one.columns)).scalar())
    return packed.select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in one.columns])


def quantile(value: Column, p: float, error: float = 0.0) -> Column:
    """Aggregate: the p-quantile, linear between values and exact, which keeps a group's different values in one
    task; with ``error`` > 0 a value whose rank is off by at most that share, from a mergeable sketch of
    bounded size, for groups of any number of values."""
    return F.percentile_approx(value, p, max(100, round(1 / error))) if error else F.percentile(value, p)
