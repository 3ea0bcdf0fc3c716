"""Attribute-value rows into wide, typed rows.

Pairs are resolved (attribute spellings to one name, values to one writing), each entity's pairs
are aggregated into a key-value map, and the known keys are projected into typed columns; what a
type can't hold stays in a map of cast failures. Contradicting values get their own slot, so every
map holds at most one value per known attribute however many an entity has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Texts that stand for no value.
FILLERS = ("", "-", "--", "null", "none", "nan", "na", "n/a", "n.a.", "unknown", "not applicable", "not reported", "not rated", "nr", "see note", "tbd")
TYPES = {"int": "bigint", "double": "double", "boolean": "boolean", "string": "string"}


@dataclass(frozen=True)
class Attribute:
    """``name`` of the result column, ``data_type`` (int, double, boolean, string) and the ``ids``
    it goes by, as :func:`clean_id` or :func:`clean_name` writes them."""

    name: str
    data_type: str
    ids: tuple[str, ...]


def clean_id(col: Column) -> Column:
    """A numeric id without blanks, leading zeros and a decimal ending: ' 0240.0' becomes '240'."""
    t = F.regexp_replace(F.trim(col), r"\.0*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^#", ""), r"^0+(?=\d)", "")


def clean_name(col: Column) -> Column:
    """A name in lower case with letters and digits only."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def clean_value(value: Column, data_type: Column) -> Column:
    """Trimmed value with fillers as null. Whole-number writings of int attributes ('+8', '08',
    '8.00', '2,013', '8 stars') become one."""
    t = F.regexp_replace(value, r"^\s+|\s+$", "")
    number = r"^([+-]?)0*(\d{1,3}(?:,\d{3})+|\d+)(?:\.0*)?(?:\s*stars?)?$"
    sign = F.when(F.regexp_extract(t, number, 1) == "-", "-").otherwise("")
    whole = F.concat(sign, F.replace(F.regexp_extract(t, number, 2), F.lit(","), F.lit("")))
    t = F.when(F.lower(t).isin(*FILLERS), None).otherwise(t)
    return F.when((data_type == "int") & F.lower(t).rlike(number), whole).otherwise(t)


def _typed(raw: Column, data_type: str) -> Column:
    if data_type == "string":
        return raw
    if data_type == "boolean":
        low = F.lower(raw)
        return F.when(low.isin("true", "yes", "y", "1", "standard"), True).when(low.isin("false", "no", "n", "0"), False)
    if data_type == "int":
        return F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("bigint"))
    v = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def entity_maps(df: DataFrame, keys: list[str], attribute: Column, value: str, spec: list[Attribute], recency: str | None = None, latest: bool = False) -> DataFrame:
    """One row per entity and slot: ``keys``, ``slot`` (bigint) and ``pairs`` (map name -> text).

    Slot 0 holds each attribute's latest value (by ``recency``; then the more frequent, then the
    smaller text), slot k its k-th other value; with ``latest`` there is only slot 0. Null keys are a key
    of their own. Unknown attributes, nulls and fillers give nothing. Repeats are combined before the
    first shuffle. The latest value comes from an aggregation; the slots of further values sort the
    different values of each (entity, attribute), which spills. Nothing collects a whole entity.
    """
    names = {i: a.name for a in spec for i in a.ids}
    kinds = {a.name: a.data_type for a in spec}
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map(F.lit(""), F.lit(""))
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.try_element_at(as_map(names), attribute).alias("__a"), F.col(value).alias("__raw"), (F.col(recency) if recency else F.lit(None).cast("timestamp")).alias("__at"))
    rows = rows.filter(F.col("__a").isNotNull()).withColumn("__v", clean_value(F.col("__raw"), F.try_element_at(as_map(kinds), F.col("__a")))).filter(F.col("__v").isNotNull())
    distinct = rows.groupBy(*k, "__a", "__v").agg(F.max("__at").alias("__at"), F.count("*").alias("__n"))
    if latest:
        first = F.struct(F.col("__at").isNull().alias("none"), (-F.unix_micros(F.col("__at").cast("timestamp"))).alias("at"), (-F.col("__n")).alias("n"), F.col("__v").alias("v"))
        slotted = distinct.groupBy(*k, "__a").agg(F.min_by("__v", first).alias("__v")).withColumn("__slot", F.lit(0).cast("bigint"))
    else:
        order = W.partitionBy(*k, "__a").orderBy(F.col("__at").desc_nulls_last(), F.col("__n").desc(), F.col("__v"))
        slotted = distinct.withColumn("__slot", (F.row_number().over(order) - 1).cast("bigint"))
    maps = slotted.groupBy(*k, "__slot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__a", "__v")))).alias("__pairs"))  # at most len(spec) pairs
    return maps.select(*[F.col(n).alias(c) for c, n in zip(keys, k)], F.col("__slot").alias("slot"), F.col("__pairs").alias("pairs"))


def project_typed(maps: DataFrame, keys: list[str], spec: list[Attribute], failures: str = "cast_failures") -> DataFrame:
    """Typed column per attribute from ``pairs``, and the map of texts that didn't fit their type."""
    cols = [_typed(F.col("pairs")[a.name], a.data_type).cast(TYPES[a.data_type]).alias(a.name) for a in spec]
    failed = F.map_filter(F.col("pairs"), lambda n, v: F.lit(False) | F.coalesce(*[F.when(n == a.name, _typed(v, a.data_type).isNull()) for a in spec], F.lit(False)))
    return maps.select(*keys, *[c for c in ["slot"] if c in maps.columns], *cols, failed.alias(failures))


def eav_to_wide(df: DataFrame, keys: list[str], attribute: Column, value: str, spec: list[Attribute], recency: str | None = None) -> DataFrame:
    """One typed row per entity (latest values). Entities with only unknown attributes or missing
    values have no row; an empty table gives an empty one. Extra input columns are ignored."""
    return project_typed(entity_maps(df, keys, attribute, value, spec, recency, latest=True), keys, spec).drop("slot")


def whole_values(df: DataFrame, keys: list[str], attribute: Column, value: str, spec: list[Attribute], recency: str | None = None) -> DataFrame:
    """``keys``, attribute_name, int_value: every distinct whole number an entity has for an int attribute."""
    ints = [a for a in spec if a.data_type == "int"]
    if not ints:
        return df.select(*keys, F.lit("").alias("attribute_name"), F.lit(0).cast("bigint").alias("int_value")).limit(0)
    wide = project_typed(entity_maps(df, keys, attribute, value, ints, recency), keys, ints)
    pairs = F.array_compact(F.array(*[F.when(F.col(f"`{a.name}`").isNotNull(), F.struct(F.lit(a.name).alias("a"), F.col(f"`{a.name}`").alias("v"))) for a in ints]))
    long = wide.select(*keys, F.explode(pairs).alias("__x"))
    return long.select(*keys, F.col("__x.a").alias("attribute_name"), F.col("__x.v").alias("int_value"))


def spec_from_metadata(meta: DataFrame, limit: int = 5000) -> list[Attribute]:
    """Attributes from a metadata table (variable_code, variable_id, data_type); an error beyond ``limit``
    rows, or where an attribute has two types or an id names two attributes. Rows with a null in one of
    them or an unknown type are left out, repeats count once, an attribute has all of its ids."""
    known = meta.select("variable_code", clean_id(F.col("variable_id")).alias("i"), "data_type").dropna().filter(F.col("data_type").isin(*TYPES)).distinct()
    rows = sorted(known.limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError("too many attributes for one wide table")
    kinds = {r[0]: r[2] for r in rows}
    if any(kinds[r[0]] != r[2] for r in rows) or len({r[1] for r in rows}) < len(rows):
        raise ValueError("an attribute has two types or an id names two attributes")
    return [Attribute(name, kind, tuple(r[1] for r in rows if r[0] == name)) for name, kind in sorted(kinds.items())]


#: Fields of the safety ratings.
SAFETY = [
    *(Attribute(n, "int", (n.lower(),)) for n in ("OverallRating", "OverallFrontCrashRating", "OverallSideCrashRating", "RolloverRating", "SidePoleCrashRating", "ComplaintsCount", "RecallsCount", "InvestigationCount", "ModelYear")),
    *(Attribute(n, "string", (n.lower(),)) for n in ("Make", "Model", "VehicleDescription", "ElectronicStabilityControl", "ForwardCollisionWarning", "LaneDepartureWarning", "dynamicTipResult")),
    Attribute("RolloverPossibility", "double", ("rolloverpossibility",)),
]
