"""Queries p4 to p7: data shaping for training data, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eav, packed, shred, units
from ..sources import read_table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spec = eav.spec_from_metadata(read_table(spark, d, "nhtsa_vpic_variable_metadata"))
    vpic = eav.whole_values(read_table(spark, d, "nhtsa_vpic_values"), ["vin", "model_year_hint"], eav.clean_id(F.col("variable_id")), "value", spec, "fetched_at")
    safety = eav.whole_values(read_table(spark, d, "nhtsa_safety_rating_values"), ["query_id", "vehicle_id"], eav.clean_name(F.col("field_name")), "field_value", eav.SAFETY)
    out = lambda df, name, a, b: df.select(F.lit(name).alias("source_table"), F.coalesce(F.col(a).cast("string"), F.lit("")).alias("key_a"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("key_b"), "attribute_name", "int_value")
    return out(vpic, "nhtsa_vpic_values", "vin", "model_year_hint").unionByName(out(safety, "nhtsa_safety_rating_values", "query_id", "vehicle_id"))


def p4_vpic_wide(spark: SparkSession, d: str) -> DataFrame:
    spec = eav.spec_from_metadata(read_table(spark, d, "nhtsa_vpic_variable_metadata"))
    wide = eav.eav_to_wide(read_table(spark, d, "nhtsa_vpic_values"), ["vin", "model_year_hint"], eav.clean_id(F.col("variable_id")), "value", spec, "fetched_at")
    return wide.withColumn("cast_failures", F.to_json("cast_failures"))


def p4_safety_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = eav.eav_to_wide(read_table(spark, d, "nhtsa_safety_rating_values"), ["query_id", "vehicle_id"], eav.clean_name(F.col("field_name")), "field_value", eav.SAFETY)
    return wide.withColumn("cast_failures", F.to_json("cast_failures"))


def _common(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(read_table(spark, d, "used_cars"), read_table(spark, d, "feed_notes"), read_table(spark, d, "fx_rates"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.converted_values(_common(spark, d))


def p5_common_units(spark: SparkSession, d: str) -> DataFrame:
    return _common(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, groups in (("nhtsa_complaints", shred.COMPLAINT_GROUPS), ("nhtsa_recalls", shred.RECALL_GROUPS)):
        rows = shred.shred_tables(read_table(spark, d, name), "row_id", "record_json", groups, fields=False)
        rows = rows.select(F.lit(name).alias("source_table"), "row_id", "array_path", "pos_path")
        out = rows if out is None else out.unionByName(rows)
    return out


def p6_shredded(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, groups in (("nhtsa_complaints", shred.COMPLAINT_GROUPS), ("nhtsa_recalls", shred.RECALL_GROUPS)):
        rows = shred.shred_tables(read_table(spark, d, name), "row_id", "record_json", groups)
        rows = rows.select(F.lit(name).alias("source_table"), "row_id", "array_path", "pos_path", "parent_path", F.to_json("fields").alias("fields_json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.explode_packed(read_table(spark, d, "used_cars"), ["row_id"], "major_options", "pos", "option_label")


QUERIES = {f.__name__: f for f in (p4_found, p4_vpic_wide, p4_safety_wide, p5_found, p5_common_units, p6_found, p6_shredded, p7_found)}

# The SQL has words, names and patterns of its own, taken from the tables' description.
_FILL = "'', '-', '--', 'n/a', 'na', 'n.a.', 'none', 'null', 'nan', 'unknown', 'tbd', 'nr', 'not rated', 'not reported', 'not applicable', 'see note'"
_CLEAN_ID = r"regexp_replace(regexp_replace(trim(variable_id), '\.0*$', ''), '^#?0*([0-9])', '\1')"
_STARS = r"regexp_replace(lower(v), '\s*stars?$', '')"
_GROUPED = rf"CASE WHEN regexp_full_match({_STARS}, '[+-]?[0-9]+(,[0-9][0-9][0-9])*(\.0*)?') AND NOT regexp_matches({_STARS}, '[0-9][0-9][0-9][0-9],') THEN replace({_STARS}, ',', '') END"
_NUM = f"try_cast(split_part({_GROUPED}, '.', 1) AS BIGINT)"
_SAFETY_INT = "('OverallRating'), ('OverallFrontCrashRating'), ('OverallSideCrashRating'), ('RolloverRating'), ('SidePoleCrashRating'), ('ComplaintsCount'), ('RecallsCount'), ('InvestigationCount'), ('ModelYear')"


def _money(col: str) -> str:
    return rf"""(CASE WHEN regexp_matches(lower({col}), 'mxn|mex\$|mexic|\bpesos?\b') THEN 'MXN' WHEN regexp_matches(lower({col}), '\bcad\b|cdn|\bc\$|ca\$|canad') THEN 'CAD'
 WHEN regexp_matches(lower({col}), '€|\beur\b|\beuros?\b|\bkeur\b') THEN 'EUR' WHEN regexp_matches(lower({col}), '\$|usd|\busc\b|dollar|\bcents?\b') THEN 'USD' END
 || CASE WHEN regexp_matches(lower({col}), '\bcents?\b|\busc\b') THEN '/100' WHEN regexp_matches(lower({col}), 'thousand|x ?1[,.]?000|\bk ?\$|\bkusd\b') THEN '*1000' ELSE '' END)"""


def _length(col: str) -> str:
    kinds = (("cm", "cm|centimet(er|re)s?"), ("mm", "mm|millimet(er|re)s?"), ("ft", "ft|feet|foot"), ("m", "m|mtrs?|met(er|re)s?"), ("in", "in|inch|inches"))
    return "(CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '(^|[^a-z])({p})([^a-z]|$)') THEN '{u}'" for u, p in kinds) + " END)"


_P5 = rf"""
WITH n AS (SELECT feed, {_length("note")} AS lu, {_money("note")} AS mu FROM feed_notes),
r AS (SELECT currency || s AS u, usd_per_unit * f AS k FROM fx_rates, (VALUES ('', 1.0::DOUBLE), ('/100', 0.01), ('*1000', 1000.0)) x(s, f)),
l(u, k) AS (VALUES ('in', 1.0::DOUBLE), ('ft', 12.0), ('cm', 1 / 2.54::DOUBLE), ('mm', 1 / 25.4::DOUBLE), ('m', 100 / 2.54::DOUBLE)),
h AS (SELECT row_id, feed, replace(replace(lower(trim(height)), '′', ''''), '″', '"') AS t FROM used_cars WHERE height IS NOT NULL),
g AS (SELECT row_id, feed, t, regexp_extract(t, '^([0-9][0-9.,]*)', 1) AS num, trim(regexp_replace(regexp_replace(t, '^[0-9][0-9.,]*\s*', ''), '\.$', '')) AS rest,
  regexp_extract(t, '^(\d+)\s*(?:''|ft|feet)\s*(\d+)\s*(?:"|in|inches)$', ['f', 'i']) AS fi, regexp_matches(t, '^\d+ \d+/\d+') AS frac FROM h WHERE regexp_matches(t, '^[0-9]')),
w AS (SELECT g.row_id, fi, num, coalesce(CASE WHEN rest = '"' THEN 'in' ELSE {_length("rest")} END, CASE WHEN rest = '' THEN coalesce(n.lu, 'in') END) AS u FROM g LEFT JOIN n USING (feed) WHERE NOT frac),
x AS (SELECT row_id, CASE WHEN fi.f <> '' THEN try_cast(fi.f AS DOUBLE) * 12 + try_cast(fi.i AS DOUBLE) ELSE CASE WHEN u = 'mm' AND regexp_full_match(num, '\d{{1,3}}(,\d{{3}})+') THEN try_cast(replace(num, ',', '') AS DOUBLE) ELSE try_cast(replace(num, ',', '.') AS DOUBLE) END * k END AS v, fi.f <> '' OR u <> 'in' AS keep FROM w LEFT JOIN l USING (u)),
p AS (SELECT row_id, price, coalesce({_money("price_unit")}, {_money("description")}, n.mu, 'USD') AS u FROM used_cars LEFT JOIN n USING (feed) WHERE price IS NOT NULL)
"""

ORACLE = {
    "p4_found": rf"""
WITH m AS (SELECT variable_code, variable_id FROM nhtsa_vpic_variable_metadata WHERE data_type = 'int'),
a AS (SELECT vin, model_year_hint, variable_code, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v FROM (SELECT *, {_CLEAN_ID} AS cid FROM nhtsa_vpic_values) x JOIN m ON x.cid = m.variable_id),
s AS (SELECT query_id, vehicle_id, n.name, regexp_replace(field_value, '^\s+|\s+$', '', 'g') AS v FROM nhtsa_safety_rating_values r JOIN (VALUES {_SAFETY_INT}) n(name) ON lower(regexp_replace(field_name, '[^\p{{L}}\p{{N}}]', '', 'g')) = lower(n.name)),
u AS (SELECT DISTINCT 'nhtsa_vpic_values' AS source_table, coalesce(vin, '') AS key_a, coalesce(model_year_hint::VARCHAR, '') AS key_b, variable_code AS attribute_name, {_NUM} AS int_value FROM a
UNION ALL SELECT DISTINCT 'nhtsa_safety_rating_values', coalesce(query_id::VARCHAR, ''), coalesce(vehicle_id, ''), name, {_NUM} FROM s)
SELECT * FROM u WHERE int_value IS NOT NULL""",
    "p5_found": _P5 + r"""
SELECT row_id, 'height' AS field_name, round(v)::BIGINT AS common_value FROM x WHERE keep AND v IS NOT NULL
UNION ALL SELECT row_id, 'price', round(round(price * k, 6))::BIGINT FROM p JOIN r USING (u) WHERE u <> 'USD'""",
}

ORACLE["p5_common_units"] = _P5 + r"""
SELECT c.row_id, x.v AS height_in, CASE WHEN x.v IS NOT NULL THEN NOT x.keep END AS height_recorded_in_inches, round(p.price * r.k, 6) AS price_usd, CASE WHEN p.price IS NOT NULL THEN p.u = 'USD' END AS price_recorded_in_usd
FROM used_cars c LEFT JOIN (SELECT row_id, v, keep FROM x WHERE v IS NOT NULL UNION ALL SELECT row_id, split_part(t, ' ', 1)::DOUBLE + split_part(split_part(t, ' ', 2), '/', 1)::DOUBLE / split_part(split_part(t, ' ', 2), '/', 2)::DOUBLE, false FROM g WHERE frac) x ON x.row_id = c.row_id
LEFT JOIN p ON p.row_id = c.row_id LEFT JOIN r ON r.u = p.u"""

_TYPED = {
    "int": r"CASE WHEN regexp_full_match(cv, '-?\d+') THEN try_cast(cv AS BIGINT) END",
    "double": "CASE WHEN isfinite(try_cast(replace(cv, ',', '') AS DOUBLE)) THEN try_cast(replace(cv, ',', '') AS DOUBLE) END",
    "boolean": "CASE WHEN lower(cv) IN ('true', 'yes', 'y', '1', 'standard') THEN true WHEN lower(cv) IN ('false', 'no', 'n', '0') THEN false END",
    "string": "cv",
}
_VPIC = [("ABS", "string"), ("CurbWeightLB", "int"), ("DisplacementCC", "int"), ("DisplacementL", "double"), ("Doors", "int"), ("EngineCylinders", "int"), ("EngineHP", "int"), ("Make", "string"), ("Model", "string"), ("ModelYear", "int"), ("PlantCity", "string"), ("SeatRows", "int"), ("Seats", "int"), ("TPMS", "string"), ("TopSpeedMPH", "int"), ("TransmissionSpeeds", "int"), ("Trim", "string"), ("Turbo", "boolean"), ("WheelBaseShort", "double"), ("Windows", "int")]


def _wide_sql(rows: str, keys: str, attributes: list[tuple[str, str]]) -> str:
    """``rows`` gives keys, a (attribute), k (data type), v (trimmed value), t (time or null)."""
    clean = rf"CASE WHEN lower(v) IN ({_FILL}) THEN NULL WHEN k = 'int' AND {_NUM} IS NOT NULL THEN ({_NUM})::VARCHAR ELSE v END"
    cols = ", ".join(f"max({_TYPED[k]}) FILTER (a = '{n}') AS \"{n}\"" for n, k in attributes)
    fails = " OR ".join(f"(k = '{k}' AND ({x}) IS NULL)" for k, x in _TYPED.items())
    return rf"""
WITH s AS ({rows}), c AS (SELECT *, {clean} AS cv FROM s), g AS (SELECT {keys}, a, k, cv, max(t) AS t, count(*) AS n FROM c WHERE cv IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, a ORDER BY t DESC NULLS LAST, n DESC, cv) AS rn FROM g)
SELECT {keys}, {cols}, '{{' || coalesce(string_agg('"' || a || '":"' || cv || '"', ',' ORDER BY a) FILTER ({fails}), '') || '}}' AS cast_failures FROM r WHERE rn = 1 GROUP BY {keys}"""


_SAFETY = [(x, "int") for x in ("OverallRating", "OverallFrontCrashRating", "OverallSideCrashRating", "RolloverRating", "SidePoleCrashRating", "ComplaintsCount", "RecallsCount", "InvestigationCount", "ModelYear")]
_SAFETY += [(x, "string") for x in ("Make", "Model", "VehicleDescription", "ElectronicStabilityControl", "ForwardCollisionWarning", "LaneDepartureWarning", "dynamicTipResult")] + [("RolloverPossibility", "double")]
_KINDS = ", ".join(f"('{n}', '{k}')" for n, k in _SAFETY)
ORACLE["p4_vpic_wide"] = _wide_sql(rf"SELECT vin, model_year_hint, variable_code AS a, data_type AS k, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v, fetched_at AS t FROM (SELECT *, {_CLEAN_ID} AS cid FROM nhtsa_vpic_values) x JOIN nhtsa_vpic_variable_metadata m ON x.cid = m.variable_id", "vin, model_year_hint", _VPIC)
ORACLE["p4_safety_wide"] = _wide_sql(rf"SELECT query_id, vehicle_id, n.name AS a, n.kind AS k, regexp_replace(field_value, '^\s+|\s+$', '', 'g') AS v, NULL::TIMESTAMP AS t FROM nhtsa_safety_rating_values r JOIN (VALUES {_KINDS}) n(name, kind) ON lower(regexp_replace(field_name, '[^\p{{L}}\p{{N}}]', '', 'g')) = lower(n.name)", "query_id, vehicle_id", _SAFETY)

_DELIM = r",;|\t\r\n•"
_TOKEN = rf"""[{_DELIM}]\s*("(?:\\.|""|[^"\\])*"|''(?:\\.|[^''\\])*''|[^{_DELIM}]*)"""
ORACLE["p7_found"] = rf"""
WITH b AS (SELECT row_id, regexp_replace(trim(major_options), '^[\[{{](.*)[\]}}]$', '\1', 's') AS body FROM used_cars WHERE lower(trim(major_options)) NOT IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nan', 'unknown')),
l AS (SELECT row_id, regexp_extract_all(',' || body, '{_TOKEN}', 1) AS toks FROM b), t AS (SELECT row_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM l),
u AS (SELECT row_id, i, trim(tok) AS tok FROM t),
c AS (SELECT row_id, i, trim(CASE WHEN left(tok, 1) IN ('"', '''') AND right(tok, 1) = left(tok, 1) AND length(tok) > 1 THEN regexp_replace(replace(replace(tok[2:-2], '""', '"'), chr(92) || 'u00b0', chr(176)), '\\(.)', '\1', 'g') ELSE tok END) AS option_label FROM u)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i)::BIGINT AS pos, option_label FROM c WHERE option_label <> ''"""
