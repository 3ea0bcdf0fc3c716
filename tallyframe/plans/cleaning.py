"""Cleaning queries: tolerant parsing, JSON expansion, profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import canonical, finite, parse_double, parse_int
from ..operators import clean as CL
from ..operators import joins as J
from ..operators import frames as FR
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN '' WHEN 1 THEN 'invalid' WHEN 2 THEN '1e500' WHEN 3 THEN '-' || l_quantity::VARCHAR WHEN 4 THEN (l_quantity / 2)::VARCHAR WHEN 5 THEN ' ' || l_quantity::INT::VARCHAR || ' in ' WHEN 6 THEN l_quantity::INT::VARCHAR || '.4999' ELSE l_quantity::INT::VARCHAR END AS raw FROM lineitem),
c AS (SELECT *, regexp_replace(trim(raw), '(\\.\\d)\\d*$', '\\1') AS cut, trim(regexp_replace(raw, '\\s*in\\s*$', '')) AS stripped FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(trim(raw), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') THEN round(try_cast(cut AS DECIMAL(38, 1)), 0)::BIGINT END AS as_int,
 CASE WHEN regexp_full_match(stripped, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') AND isfinite(try_cast(stripped AS DOUBLE)) THEN try_cast(stripped AS DOUBLE) END AS as_double FROM c
""")
def tolerant_numbers(t: Tables):
    """Numbers read from text: bad, blank and non-finite are null, halves round away from zero."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    whole = F.col("l_quantity").cast("int").cast("string")
    raw = (
        F.when(k == 0, "").when(k == 1, "invalid").when(k == 2, "1e500").when(k == 3, F.concat(F.lit("-"), F.col("l_quantity").cast("string"))).when(k == 4, (F.col("l_quantity") / 2).cast("string"))
        .when(k == 5, F.concat(F.lit(" "), whole, F.lit(" in "))).when(k == 6, F.concat(whole, F.lit(".4999"))).otherwise(whole)
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", parse_int(F.col("raw")).alias("as_int"), parse_double(F.col("raw"), "in").alias("as_double"))


@q("""SELECT event_id, (props->>'k')::BIGINT AS k FROM events""")
def json_expand(t: Tables):
    """JSON objects as typed columns, with keys and types found by one job over the whole table."""
    found = {r.key: r.kind for r in CL.json_keys(t.events, "props").collect()}  # one row per key
    return CL.expand_json(t.events.select("event_id", "props"), "props", found)


@q("""
WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*)::BIGINT AS n, 'int' AS kind FROM k GROUP BY 1
""")
def json_key_types(t: Tables):
    return CL.json_keys(t.events, "props")


@q()
def strict_json(t: Tables):
    """Records that aren't strict JSON objects, with the reason."""
    rows = t.nhtsa_complaints.select("row_id", CL.strict_json_error(F.col("record_json")).alias("reason"))
    return rows.filter("reason IS NOT NULL")


@q("""
SELECT 'price' AS column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (price IS NULL)::BIGINT AS missing, count(DISTINCT price)::BIGINT AS distinct_values FROM used_cars
UNION ALL SELECT 'mileage', count(*), count(*) FILTER (mileage IS NULL OR isnan(mileage)), count(DISTINCT mileage) FILTER (NOT isnan(mileage)) FROM used_cars
UNION ALL SELECT 'city', count(*), count(*) FILTER (city IS NULL OR trim(city) = ''), count(DISTINCT city) FILTER (trim(city) <> '') FROM used_cars
""")
def column_profile(t: Tables):
    return CL.column_profile(t.used_cars, ["price", "mileage", "city"])


@q("""
WITH l AS (SELECT 'make_name' AS c, make_name AS raw FROM used_cars UNION ALL SELECT 'trim_name', trim_name FROM used_cars), r AS (SELECT c, raw, count(*) AS n, upper(regexp_replace(trim(raw), '\\s+', ' ', 'g')) AS level FROM l WHERE raw IS NOT NULL AND trim(raw) <> '' GROUP BY ALL),
g AS (SELECT c, level, sum(n) AS n, count(*) AS s FROM r GROUP BY ALL)
SELECT c AS column_name, sum(s)::BIGINT AS raw_levels, count(*)::BIGINT AS levels, count(*) FILTER (n <= 20)::BIGINT AS rare_levels, coalesce(sum(n) FILTER (n <= 20), 0)::BIGINT AS rare_rows FROM g GROUP BY 1
""")
def category_rarity(t: Tables):
    return CL.rarity(t.used_cars, ["make_name", "trim_name"], 20)


@q("""
WITH p AS (SELECT vin, count(*) AS n FROM used_cars GROUP BY 1) SELECT count(*)::BIGINT AS n_keys, count(*) FILTER (n > 1)::BIGINT AS repeated_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_affected, max(n)::BIGINT AS largest FROM p
""")
def key_quality(t: Tables):
    return CL.key_quality(t.used_cars, ["vin"])


@q("""
SELECT 'height' AS column_name, count(*) FILTER (height IS NULL)::BIGINT AS nulls_before, count(*) FILTER (v IS NULL)::BIGINT AS nulls_after, (count(*) FILTER (v IS NULL) - count(*) FILTER (height IS NULL))::BIGINT AS new_nulls
FROM (SELECT height, CASE WHEN regexp_full_match(trim(regexp_replace(height, '\\s*in\\s*$', '')), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN 1 END AS v FROM used_cars)
""")
def null_accounting(t: Tables):
    """Nulls that a conversion adds."""
    return CL.new_nulls(t.used_cars, {"height": F.col("height")}, {"height": parse_double(F.col("height"), "in")})


@q("""
SELECT row_id, CASE WHEN upper(regexp_replace(trim(body_type), '\\s+', ' ', 'g')) NOT IN ('', 'UNKNOWN', 'NOT APPLICABLE', 'N/A', '--') THEN upper(regexp_replace(trim(body_type), '\\s+', ' ', 'g')) END AS body,
 CASE WHEN NOT isnan(mileage) AND NOT isinf(mileage) THEN mileage END AS mileage, try_cast(nullif(regexp_extract(maximum_seating, '(\\d+)', 1), '') AS INT) AS seats FROM used_cars
""")
def canonical_columns(t: Tables):
    return t.used_cars.select("row_id", canonical(F.col("body_type")).alias("body"), finite(F.col("mileage")).alias("mileage"), F.regexp_extract("maximum_seating", r"(\d+)", 1).try_cast("int").alias("seats"))


@q("""
SELECT 'a' AS src, c_custkey::VARCHAR AS id, c_name AS name, NULL::DOUBLE AS acctbal FROM customer UNION ALL BY NAME SELECT 'b' AS src, s_suppkey::VARCHAR AS id, s_name AS name, s_acctbal AS acctbal FROM supplier
""")
def union_relaxed(t: Tables):
    """Union by name with missing columns as null."""
    a = t.customer.select(F.lit("a").alias("src"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.lit("b").alias("src"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return J.union_relaxed(a, b)


@q("""
SELECT row_id, field, val FROM (SELECT row_id, horsepower AS hp, city_fuel_economy AS city, highway_fuel_economy AS highway FROM used_cars) UNPIVOT (val FOR field IN (hp, city, highway))
""")
def unpivoted(t: Tables):
    """Numeric columns as field and value rows, nulls left out."""
    rows = t.used_cars.select("row_id", F.col("horsepower").alias("hp"), F.col("city_fuel_economy").alias("city"), F.col("highway_fuel_economy").alias("highway"))
    return rows.unpivot("row_id", ["hp", "city", "highway"], "field", "val").filter("val IS NOT NULL")


@q("""
SELECT row_id, (listed_date + daysonmarket::INT)::DATE AS proxy_date FROM used_cars WHERE daysonmarket BETWEEN 0 AND 10000
""")
def date_proxy(t: Tables):
    """Listing date plus days on the market."""
    return t.used_cars.select("row_id", FR.date_after(F.col("listed_date"), F.col("daysonmarket")).alias("proxy_date"), "daysonmarket").filter("daysonmarket BETWEEN 0 AND 10000").drop("daysonmarket")


@q("""
SELECT has_accidents, frame_damaged, count(*)::BIGINT AS n, count(*) FILTER (lower(has_accidents) = 'false' AND lower(frame_damaged) = 'false')::BIGINT AS clean FROM used_cars GROUP BY ALL
""")
def history_flags(t: Tables):
    ok = (F.lower("has_accidents") == "false") & (F.lower("frame_damaged") == "false")
    return t.used_cars.groupBy("has_accidents", "frame_damaged").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("clean"))
