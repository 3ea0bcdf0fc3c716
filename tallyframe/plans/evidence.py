"""Evidence queries: conflicts, applicability, features per family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import evidence as E
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
WITH bad AS (SELECT user_id FROM events GROUP BY user_id, event_type HAVING count(DISTINCT props) + max((props IS NULL)::INT) > 60)
SELECT event_type, count(*)::BIGINT AS n_events, count(DISTINCT user_id)::BIGINT AS n_users FROM events e
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.user_id IS NOT DISTINCT FROM e.user_id) GROUP BY 1
""")
def conflict_free_events(t: Tables):
    """Counts without the keys that have too many versions, null-safe."""
    v = t.events.groupBy("user_id", "event_type").agg(E.n_unique_with_null(F.col("props")).alias("n"))
    bad = v.filter("n > 60").select(F.col("user_id").alias("bad_id")).distinct()
    kept = t.events.join(bad, F.col("user_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return kept.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"))


@q("""
SELECT query_id, vehicle_id, count(DISTINCT coalesce(field_value, chr(0)))::BIGINT AS n_versions, (count(DISTINCT field_value) + max((field_value IS NULL)::INT))::BIGINT AS n_field_value
FROM nhtsa_safety_rating_values WHERE lower(replace(replace(trim(field_name), ' ', ''), '_', '')) = 'modelyear' GROUP BY ALL
""")
def rating_versions(t: Tables):
    """Versions of one attribute per entity; a value against null is a conflict."""
    rows = t.nhtsa_safety_rating_values.filter(F.lower(F.replace(F.replace(F.trim("field_name"), F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))) == "modelyear")
    return E.versions(rows, ["query_id", "vehicle_id"], ["field_value"])


@q("""
SELECT p_brand, count(DISTINCT trim(w))::BIGINT AS n_components, count(DISTINCT p_partkey)::BIGINT AS n_records
FROM (SELECT p_brand, p_partkey, unnest(string_split(replace(p_name, ' ', ','), ',')) AS w FROM part) WHERE trim(w) <> '' GROUP BY 1
""")
def component_counts(t: Tables):
    return E.component_counts(t.part.withColumn("words", F.replace("p_name", F.lit(" "), F.lit(","))), ["p_brand"], "p_partkey", "words")


@q("""
WITH p AS (SELECT event_id, user_id, CASE WHEN (props->>'k')::INT % 4 = 0 THEN NULL ELSE (props->>'k')::INT END AS k, event_type FROM events)
SELECT event_id, CASE WHEN k IS NULL OR event_type = 'view' THEN 'unsupported' WHEN k % 10 = user_id % 10 THEN 'exact' ELSE 'conflict' END AS status FROM p
""")
def applicability_status(t: Tables):
    """Whether the products named in a record apply to the family asked for."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "TIRE").otherwise("Vehicle")
    product = F.struct(kind.alias("type"), (k % 10).cast("string").alias("productYear"), F.lit("a").alias("productMake"), F.lit("b").alias("productModel"))
    rows = t.events.withColumn("products", F.when(k % 4 != 0, F.array(product)))
    return rows.select("event_id", E.applicable(F.col("products"), F.col("user_id") % 10, F.lit("A"), F.lit("B")).alias("status"))


@q("""
WITH first AS (SELECT user_id, event_type, arg_min(value, event_id) AS value, (count(DISTINCT props) > 1)::INT AS conflict FROM events GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS n_types, sum(conflict)::BIGINT AS n_conflicts, round(sum(CASE WHEN conflict = 0 THEN value END), 6) AS clean_value FROM first GROUP BY 1
""")
def family_issue_features(t: Tables):
    """Two-level features: first version and conflict flag per id, then counts and conditional sums."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"), (F.count_distinct("props") > 1).cast("int").alias("conflict"))
    return first.groupBy("user_id").agg(F.count("*").alias("n_types"), F.sum("conflict").cast("bigint").alias("n_conflicts"), F.round(F.sum(F.when(F.col("conflict") == 0, F.col("value"))), 6).alias("clean_value"))


@q("""
SELECT make, model, count(DISTINCT record_key)::BIGINT AS n_records, count(*)::BIGINT AS n_rows FROM nhtsa_complaints GROUP BY ALL
""")
def complaint_counts(t: Tables):
    return t.nhtsa_complaints.groupBy("make", "model").agg(F.count_distinct("record_key").alias("n_records"), F.count("*").alias("n_rows"))


@q("""
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, max(CASE WHEN event_type = 'view' THEN value END) AS "view" FROM events GROUP BY 1
""")
def event_pivot(t: Tables):
    return CL.pivot_long(t.events, ["user_id"], "event_type", "value", ["click", "purchase", "view"])


@q("""
SELECT o_orderkey, year(o_orderdate) BETWEEN 1995 AND 1999 AND o_orderdate::DATE <= DATE '1997-06-30' AS exposed FROM orders
""")
def exposure_window(t: Tables):
    ok = E.exposure(F.to_date("o_orderdate"), F.lit(1995), F.lit("1997-06-30").cast("date"))
    return t.orders.select("o_orderkey", ok.alias("exposed"))


@q("""
SELECT query_id, count(*)::BIGINT AS n, count(DISTINCT record_key)::BIGINT AS campaigns FROM nhtsa_recalls GROUP BY 1
""")
def recall_campaigns(t: Tables):
    return t.nhtsa_recalls.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("record_key").alias("campaigns"))
