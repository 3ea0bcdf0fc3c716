"""Projection and scalar queries: typed features, keys, recodes, dates, text to numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import finite, hash_mod, norm_key, with_row
from ..operators import frames as FR
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle

_NK = r"upper(regexp_replace(trim({c}), '\s+', ' ', 'g'))"


@q(r"""
SELECT row_id, CASE WHEN price > 0 THEN round(ln(1 + price), 6) END AS log_price, CASE WHEN NOT isnan(mileage) AND mileage >= 0 AND NOT isinf(mileage) THEN round(ln(1 + mileage), 6) END AS log_miles,
 CASE WHEN starts_with(trim(major_options), '[') THEN (contains(major_options, 'Leather Seats'))::INT END AS has_leather, CASE WHEN starts_with(trim(major_options), '[') THEN regexp_matches(major_options, '[''"]Navigation System[''"]')::INT END AS has_navigation FROM used_cars
""")
def listing_features(t: Tables):
    """Logs and option flags; flags are null where the field is no list."""
    m, o = finite(F.col("mileage")), F.col("major_options")
    return t.used_cars.select("row_id", FR.log_if(F.col("price"), F.col("price") > 0).alias("log_price"), FR.log_if(m, m >= 0).alias("log_miles"), F.when(F.trim(o).startswith("["), o.contains("Leather Seats").cast("int")).alias("has_leather"), FR.option_flag(o, "Navigation System").alias("has_navigation"))


@q(rf"""
WITH k AS (SELECT row_id, {_NK.format(c="make_name")} AS mk, {_NK.format(c="model_name")} AS md, year FROM used_cars)
SELECT row_id, coalesce(mk, '') || '|' || coalesce(md, '') AS family_block, substr(sha256('|' || coalesce(year::VARCHAR, '') || '|' || coalesce(mk, '') || '|' || coalesce(md, '')), 1, 24) AS family_id,
 (('0x' || substr(sha256('42|' || coalesce(mk, '') || '|' || coalesce(md, '')), 1, 15))::BIGINT % 5)::BIGINT AS fold FROM k
""")
def family_ids(t: Tables):
    """Normalised family keys, digest ids and the fold of a family block (no shuffle)."""
    from ..functions.expr import sha_hex

    k = t.used_cars.select("row_id", norm_key(F.col("make_name")).alias("mk"), norm_key(F.col("model_name")).alias("md"), "year")
    block = F.concat_ws("|", F.coalesce("mk", F.lit("")), F.coalesce("md", F.lit("")))
    return k.select("row_id", block.alias("family_block"), F.substring(sha_hex("year", "mk", "md"), 1, 24).alias("family_id"), hash_mod(block, 5).alias("fold"))


@q(rf"""
WITH d AS (SELECT vin, max(value) FILTER (trim(variable_id) IN ('201', '0201', '201.0')) AS dmake FROM nhtsa_vpic_values GROUP BY 1)
SELECT row_id, coalesce({_NK.format(c="dmake")}, {_NK.format(c="make_name")}) AS make_key, CASE WHEN dmake IS NOT NULL THEN 'decoded' WHEN make_name IS NOT NULL THEN 'listing' ELSE 'missing' END AS make_source
FROM used_cars LEFT JOIN d ON d.vin = used_cars.vin
""")
def fallback_identity(t: Tables):
    """Identity from the decode, else from the listing, with its provenance."""
    d = t.nhtsa_vpic_values.groupBy("vin").agg(F.max(F.when(F.trim("variable_id").isin("201", "0201", "201.0"), F.col("value"))).alias("dmake"))
    j = t.used_cars.select("row_id", "vin", "make_name").join(d, "vin", "left")
    value, source = FR.first_source({"decoded": norm_key(F.col("dmake")), "listing": norm_key(F.col("make_name"))})
    return j.select("row_id", value.alias("make_key"), source.alias("make_source"))


@q(r"""
WITH s AS (SELECT p_partkey, (100 + p_size)::VARCHAR || ' lb-ft @ ' || (2000 + p_size * 10)::VARCHAR || ' RPM' AS raw FROM part UNION ALL SELECT -p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'none' ELSE p_size::VARCHAR || ' Nm' END FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(raw, 'lb-ft') THEN round(try_cast(regexp_extract(raw, '(\d+(?:\.\d+)?)\s*lb-ft', 1) AS DOUBLE) * 1.3558179483, 6) WHEN regexp_matches(raw, 'Nm') THEN try_cast(regexp_extract(raw, '(\d+(?:\.\d+)?)\s*Nm', 1) AS DOUBLE) END AS nm,
 try_cast(nullif(regexp_extract(raw, '(\d+)\s*RPM', 1), '') AS INT) AS rpm FROM s
""")
def torque_text(t: Tables):
    """Numbers with units out of free text, in one unit."""
    s = t.part.select("p_partkey", F.concat((F.col("p_size") + 100).cast("string"), F.lit(" lb-ft @ "), (F.col("p_size") * 10 + 2000).cast("string"), F.lit(" RPM")).alias("raw"))
    k = F.col("p_size") % 3
    s = s.unionByName(t.part.select((-F.col("p_partkey")).alias("p_partkey"), F.when(k == 1, "none").when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit(" Nm"))).alias("raw")))
    return s.select("p_partkey", FR.torque_nm(F.col("raw")).alias("nm"), FR.number_before(F.col("raw"), "RPM").cast("int").alias("rpm"))


@q(r"""
SELECT row_id, CASE WHEN major_options IS NULL OR trim(major_options) IN ('', '--') THEN 'missing' WHEN regexp_full_match(trim(major_options), '\[\s*\]') THEN 'valid_empty' WHEN regexp_full_match(trim(major_options), '\[(.|\n)*\]') THEN 'populated' ELSE 'other' END AS state FROM used_cars
""")
def option_states(t: Tables):
    """State of a packed field: missing, an empty list, a list, or something else."""
    o = F.trim("major_options")
    return t.used_cars.select("row_id", F.when(o.isNull() | o.isin("", "--"), "missing").when(o.rlike(r"^\[\s*\]$"), "valid_empty").when(o.rlike(r"(?s)^\[.*\]$"), "populated").otherwise("other").alias("state"))


@q(r"""
WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%m/%d/%Y') WHEN 1 THEN strftime(ts, '%d.%m.%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'soon' ELSE strftime(ts, '%m-%d-%Y') END AS raw FROM events)
SELECT event_id, coalesce(try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%d.%m.%Y'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m-%d-%Y'))::DATE AS day FROM s
""")
def mixed_dates(t: Tables):
    """Dates written in several formats; what fits none is null."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.date_format("ts", "MM/dd/yyyy")).when(k == 1, F.date_format("ts", "dd.MM.yyyy")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, "soon").otherwise(F.date_format("ts", "MM-dd-yyyy"))
    return t.events.select("event_id", FR.dates_in_formats(raw, ("MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "MM-dd-yyyy")).alias("day"))


@q(r"""
SELECT row_id, regexp_replace(lower(model_name), '[^a-z0-9]', '', 'g') AS catalog_key, CASE feed WHEN 'gridlot' THEN 'large' WHEN 'autoharbor' THEN 'large' WHEN 'fleetdump' THEN 'fleet' ELSE 'other' END AS feed_group FROM used_cars
""")
def recoded_labels(t: Tables):
    """Keys without punctuation, and labels recoded by a dictionary."""
    groups = {"gridlot": "large", "autoharbor": "large", "fleetdump": "fleet"}
    return t.used_cars.select("row_id", FR.catalog_key(F.col("model_name")).alias("catalog_key"), FR.recode(F.col("feed"), groups, "other").alias("feed_group"))


@q(r"""
WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '18k' WHEN 1 THEN '$18,000' WHEN 2 THEN '20.5K' WHEN 3 THEN 'cheap' ELSE ' 7500 ' END AS raw FROM customer)
SELECT c_custkey, round(try_cast(replace(regexp_extract(lower(trim(raw)), '^\$?([0-9][0-9,]*\.?[0-9]*)k?$', 1), ',', '') AS DOUBLE) * CASE WHEN ends_with(lower(trim(raw)), 'k') THEN 1000 ELSE 1 END)::BIGINT AS cap FROM s
""")
def typed_caps(t: Tables):
    """Amounts typed by people ('18k', '$18,000')."""
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "18k").when(k == 1, "$18,000").when(k == 2, "20.5K").when(k == 3, "cheap").otherwise(" 7500 ")
    return t.customer.select("c_custkey", FR.typed_amount(raw).alias("cap"))


@q(r"""
SELECT n * m AS preset FROM (VALUES (1.0), (1.5), (2.0), (2.5), (3.0), (4.0), (5.0), (7.5)) a(n), (SELECT power(10, i) AS m FROM (SELECT unnest([2, 3, 4, 5]) AS i)) WHERE n * m <= (SELECT max(o_totalprice) FROM orders) AND n * m >= (SELECT min(o_totalprice) FROM orders)
""")
def range_presets(t: Tables):
    """Round values within the range of a column."""
    return FR.range_presets(t.orders, "o_totalprice")


@q(r"""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 9) AS mean, list_max(embedding)::DOUBLE > 1.5 AS any_large, len(list_filter(embedding, lambda x: x > 0))::INT AS positives FROM embeddings
""")
def array_features(t: Tables):
    """Mean, any and counts over arrays with higher-order functions."""
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(FR.array_mean(e), 9).alias("mean"), F.exists(e, lambda x: x.cast("double") > 1.5).alias("any_large"), F.size(F.filter(e, lambda x: x > 0)).alias("positives"))


@q(r"""
SELECT row_id, string_agg(m, ';' ORDER BY pos) AS topics FROM (SELECT row_id, w.m, w.pos FROM (SELECT row_id, lower(text) AS t FROM youtube_comments_sentiment WHERE text IS NOT NULL),
 LATERAL (SELECT x.m, x.pos FROM (VALUES ('rear seat', 1), ('gearbox', 2), ('clutch', 3), ('brakes', 4), ('seat', 5)) x(m, pos) WHERE regexp_matches(t, '\b' || x.m || '\b') AND NOT (x.m = 'seat' AND NOT regexp_matches(replace(t, 'rear seat', ''), '\bseat\b'))) w) GROUP BY 1
""")
def dictionary_topics(t: Tables):
    """Dictionary terms in a text, longest match first, at word ends only."""
    terms = FR.dictionary_terms(F.col("text"), ["rear seat", "gearbox", "clutch", "brakes", "seat"])
    return t.youtube_comments_sentiment.select("row_id", F.array_join(terms, ";").alias("topics")).filter("topics <> ''")


@q(r"""
SELECT query_id, vehicle_id, CASE WHEN r BETWEEN 1 AND 5 THEN r END AS rating, r IS NULL OR NOT r BETWEEN 1 AND 5 AS missing FROM
(SELECT query_id, vehicle_id, max(try_cast(regexp_extract(trim(field_value), '^([0-9]+)(\.0*)?$', 1) AS INT)) AS r FROM nhtsa_safety_rating_values WHERE lower(regexp_replace(field_name, '[^A-Za-z0-9]', '', 'g')) = 'overallrating' GROUP BY ALL)
""")
def rating_ranges(t: Tables):
    """Ratings outside 1 to 5 are missing."""
    rows = t.nhtsa_safety_rating_values.filter(F.lower(F.regexp_replace("field_name", "[^A-Za-z0-9]", "")) == "overallrating")
    r = rows.groupBy("query_id", "vehicle_id").agg(F.max(F.regexp_extract(F.trim("field_value"), r"^([0-9]+)(\.0*)?$", 1).try_cast("int")).alias("r"))
    rating, missing = FR.in_range(F.col("r"), 1, 5)
    return r.select("query_id", "vehicle_id", rating.alias("rating"), missing.alias("missing"))


@q(r"""
SELECT o_orderkey, round(0.004 * (o_totalprice - (SELECT avg(o_totalprice) FROM orders)), 4) AS price_part, round(2.5 * (month(o_orderdate) - (SELECT avg(month(o_orderdate)) FROM orders)), 4) AS month_part FROM orders
""")
def linear_contributions(t: Tables):
    """Additive parts of a linear score: coefficient times the distance from the mean."""
    m = t.orders.agg(F.avg("o_totalprice").alias("mp"), F.avg(F.month("o_orderdate")).alias("mm"))
    j = with_row(t.orders, m)
    return j.select("o_orderkey", F.round((F.col("o_totalprice") - F.col("mp")) * 0.004, 4).alias("price_part"), F.round((F.month("o_orderdate") - F.col("mm")) * 2.5, 4).alias("month_part"))


@q(r"""
SELECT row_id, CASE WHEN lower(trim(is_new)) = 'true' THEN 'new' WHEN lower(trim(is_new)) = 'false' THEN 'used' ELSE 'unknown' END AS scope, (coalesce(length(vin), 0) <> 17)::INT AS bad_vin, (horsepower IS NOT NULL)::INT + (city_fuel_economy IS NOT NULL)::INT + (highway_fuel_economy IS NOT NULL)::INT >= 2 AS enough FROM used_cars
""")
def scope_flags(t: Tables):
    """Scope labels, key checks and the share of observed fields."""
    seen = FR.observed(["horsepower", "city_fuel_economy", "highway_fuel_economy"])
    return t.used_cars.select("row_id", FR.scope_label(F.col("is_new")).alias("scope"), (F.coalesce(F.length("vin"), F.lit(0)) != 17).cast("int").alias("bad_vin"), (seen >= 2).alias("enough"))
