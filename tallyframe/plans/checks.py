"""Invariant reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as CH
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
WITH c AS (SELECT 'orders_unique' AS check_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS v
UNION ALL SELECT 'lines_have_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'discount_range', (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05)
UNION ALL SELECT 'vin_unique', (SELECT count(*) FROM (SELECT vin FROM used_cars GROUP BY 1 HAVING count(*) > 1)))
SELECT check_name, v::BIGINT AS violations, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS status FROM c
""")
def output_checks(t: Tables):
    return CH.report({
        "orders_unique": CH.repeated(t.orders, ["o_orderkey"]),
        "lines_have_order": CH.orphans(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), ["k"]),
        "discount_range": CH.outside(t.lineitem, "l_discount", 0, 0.05),
        "vin_unique": CH.repeated(t.used_cars, ["vin"]),
    })


@q("""
SELECT k, side FROM (SELECT DISTINCT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
""")
def population_difference(t: Tables):
    """Keys on one side only."""
    a, b = t.customer.select(F.col("c_custkey").alias("k")).distinct(), t.orders.select(F.col("o_custkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("right")))


@q()
def table_fingerprint(t: Tables):
    return CH.fingerprint(t.orders)


@q("""
WITH g AS (SELECT n_nationkey AS profile, s AS dimension FROM nation, (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE')) d(s)), l AS (SELECT c_nationkey AS profile, c_mktsegment AS dimension, count(*) AS n, max(c_acctbal) AS b FROM customer GROUP BY ALL)
SELECT profile, dimension, CASE WHEN n IS NULL THEN 'no_rows' WHEN n < 5 THEN 'low_support' WHEN b < 9000 THEN 'no_high_value' ELSE 'emitted' END AS reason FROM g LEFT JOIN l USING (profile, dimension)
""")
def reason_coverage(t: Tables):
    """A reason for every profile and dimension by priority; both lists are small and fixed."""
    dims = F.explode(F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "FURNITURE")]))
    grid = t.nation.select(F.col("n_nationkey").alias("profile"), dims.alias("dimension"))
    have = t.customer.groupBy(F.col("c_nationkey").alias("profile"), F.col("c_mktsegment").alias("dimension")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("b"))
    reason = F.when(F.col("n").isNull(), "no_rows").when(F.col("n") < 5, "low_support").when(F.col("b") < 9000, "no_high_value").otherwise("emitted")
    return grid.join(have, ["profile", "dimension"], "left").select("profile", "dimension", reason.alias("reason"))
