"""Catalog queries: summaries, facets, pages, funnels, joins of listings with decodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import left_closed_band, norm_key
from ..operators import catalog as C
from ..operators import joins as J
from ..operators import frames as FR
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


def _catalog(t: Tables):
    items = t.lineitem.select("l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand", "p_type", "p_name")
    return J.checked_join(items, parts, ["l_partkey"], "left", "m:1")


@q("""
SELECT p_size, p_brand, p_type, count(*)::BIGINT AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N') AND l_quantity <= 40
GROUP BY ALL ORDER BY n DESC, p_size, p_brand, p_type LIMIT 200
""")
def catalog_cohort_summary(t: Tables):
    """Rows, median and quartiles per cohort of a filtered catalog, largest first."""
    rows = _catalog(t).filter(C.Filters({"l_returnflag": ("A", "N")}, {}, {"l_quantity": 40}).expression())
    return C.cohort_summary(rows, ["p_size", "p_brand", "p_type"], "l_extendedprice", 200)


@q("""
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT l_orderkey)::BIGINT AS n_ids,
       count(DISTINCT CASE WHEN p_size IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL THEN (p_size, p_brand, p_type) END)::BIGINT AS n_cohorts,
       quantile_cont(l_extendedprice, 0.5) AS l_extendedprice_median, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
       quantile_cont(l_quantity, 0.5) AS l_quantity_median, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
       min(l_shipdate) AS first_date, max(l_shipdate) AS last_date
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def catalog_summary(t: Tables):
    return C.scope_summary(_catalog(t), "l_orderkey", ["p_size", "p_brand", "p_type"], ["l_extendedprice", "l_quantity"], "l_shipdate")


@q("SELECT (floor(o_totalprice / 5000) * 5000)::DOUBLE AS bin, count(*)::BIGINT AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def price_histogram(t: Tables):
    return C.histogram(t.orders, "o_totalprice", 5000)


@q("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200")
def listing_page(t: Tables):
    return C.page(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 2)


@q("""
(SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)
""")
def top_extremes(t: Tables):
    return C.extremes(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 200")
def hash_sample(t: Tables):
    return C.hash_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 200)


@q("""
WITH c AS (SELECT count(*) AS c0, count(*) FILTER (l_extendedprice <= 40000) AS c1,
  count(*) FILTER (l_extendedprice <= 40000 AND l_quantity >= 10) AS c2,
  count(*) FILTER (l_extendedprice <= 40000 AND l_quantity >= 10 AND p_size <= 30) AS c3,
  count(*) FILTER (l_extendedprice <= 40000 AND l_quantity >= 10 AND p_size <= 30 AND l_returnflag = 'N') AS c4
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT i::BIGINT AS step_no, ['price', 'quantity', 'size', 'flag'][i] AS step, [c1, c2, c3, c4][i]::BIGINT AS remaining, ([c0, c1, c2, c3][i] - [c1, c2, c3, c4][i])::BIGINT AS excluded
FROM c, (SELECT unnest([1, 2, 3, 4]) AS i)
""")
def predicate_funnel(t: Tables):
    steps = [("price", F.col("l_extendedprice") <= 40000), ("quantity", F.col("l_quantity") >= 10), ("size", F.col("p_size") <= 30), ("flag", F.col("l_returnflag") == "N")]
    return C.funnel(_catalog(t), steps)


@q("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT p_brand, p_type, quantile_cont(l_extendedprice, 0.5) AS pm, quantile_cont(l_quantity, 0.5) AS qm FROM r WHERE l_extendedprice > 0 AND l_quantity >= 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, concat_ws(';', CASE WHEN l_extendedprice >= 2 * pm THEN 'price_high' END, CASE WHEN l_extendedprice <= pm / 10 THEN 'price_low' END, CASE WHEN l_quantity >= 1.9 * qm THEN 'quantity_high' END) AS reasons
FROM r JOIN g USING (p_brand, p_type) WHERE l_extendedprice >= 2 * pm OR l_extendedprice <= pm / 10 OR l_quantity >= 1.9 * qm
""")
def cohort_outliers(t: Tables):
    """Rows far from their cohort's medians, with the reasons joined."""
    r = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    rules = {"price_high": lambda m: price >= 2 * m["p"], "price_low": lambda m: price <= m["p"] / 10, "quantity_high": lambda m: quantity >= 1.9 * m["q"]}
    out = FR.cohort_reasons(r, ["p_brand", "p_type"], {"p": price, "q": quantity}, (price > 0) & (quantity >= 0), rules).filter("reasons <> ''")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "reasons")


@q("""
WITH g AS (SELECT make_name, model_name, quantile_cont(price, 0.5) AS pm, quantile_cont(mileage, 0.5) FILTER (NOT isnan(mileage)) AS mm FROM used_cars WHERE price > 0 GROUP BY ALL)
SELECT row_id FROM used_cars u LEFT JOIN g ON u.make_name = g.make_name AND u.model_name = g.model_name
WHERE coalesce(price / pm > 2 OR price / pm <= 0.75, false) OR coalesce(NOT isnan(mileage) AND mileage / mm > 20, false)
""")
def ratio_exclusion(t: Tables):
    """Listings whose price or mileage ratio to their cohort's median excludes them (strict above,
    inclusive below)."""
    cars = t.used_cars.select("row_id", "make_name", "model_name", "price", F.when(~F.isnan("mileage"), F.col("mileage")).alias("miles"))
    rules = {"high": lambda m: F.try_divide("price", m["p"]) > 2, "low": lambda m: F.try_divide("price", m["p"]) <= 0.75, "miles": lambda m: F.try_divide("miles", m["m"]) > 20}
    out = FR.cohort_reasons(cars, ["make_name", "model_name"], {"p": F.col("price"), "m": F.col("miles")}, F.col("price") > 0, rules)
    return out.filter("reasons <> ''").select("row_id")


@q("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)")
def supported_groups(t: Tables):
    return C.supported(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], 60)


@q("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey
""")
def aligned_fill(t: Tables):
    rows = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return J.aligned_fill(t.customer, rows, ["c_custkey"])


@q("""
WITH f AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) AS bal FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 <> 0 GROUP BY ALL),
c AS (SELECT n_regionkey, round(avg(c_acctbal), 6) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey <> 4 GROUP BY 1)
SELECT c_custkey, CASE WHEN f.c_nationkey IS NOT NULL THEN f.bal ELSE c.bal END AS bal,
 CASE WHEN f.c_nationkey IS NOT NULL THEN 'fine' WHEN c.n_regionkey IS NOT NULL THEN 'coarse' ELSE 'missing' END AS bal_level
FROM customer u JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON f.c_nationkey = u.c_nationkey AND f.c_mktsegment = u.c_mktsegment LEFT JOIN c ON c.n_regionkey = nation.n_regionkey
""")
def fallback_join(t: Tables):
    cust = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    pos = cust.filter("c_acctbal > 0")
    fine = pos.filter("c_nationkey % 3 <> 0").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("bal"))
    coarse = pos.filter("n_regionkey <> 4").groupBy("n_regionkey").agg(F.round(F.avg("c_acctbal"), 6).alias("bal"))
    return J.fallback_join(cust, fine, coarse, ["c_nationkey", "c_mktsegment"], ["n_regionkey"], "bal").select("c_custkey", "bal", "bal_level")


@q("""
WITH x(p_brand, lo, hi, family) AS (VALUES ('Brand#11', 1, 20, 'small'), ('Brand#11', 21, 50, 'large'), ('Brand#12', 5, 30, 'mid'), ('Brand#23', 1, 50, 'all'))
SELECT p_partkey, p_size, family FROM part LEFT JOIN x ON part.p_brand = x.p_brand AND p_size BETWEEN lo AND hi
""")
def range_crosswalk(t: Tables):
    x = t.spark.createDataFrame([("Brand#11", 1, 20, "small"), ("Brand#11", 21, 50, "large"), ("Brand#12", 5, 30, "mid"), ("Brand#23", 1, 50, "all")], "p_brand string, lo int, hi int, family string")
    return J.range_join(t.part, x, ["p_brand"], "p_size", "lo", "hi").select("p_partkey", "p_size", "family")


@q("""
WITH p AS (SELECT DISTINCT upper(trim(make_name)) AS mk, upper(trim(model_name)) AS prefix FROM used_cars WHERE make_name IS NOT NULL AND model_name IS NOT NULL),
r AS (SELECT row_id, upper(trim(make_name)) AS mk, upper(trim(model_name)) || ' ' || coalesce(upper(trim(trim_name)), '') AS txt FROM used_cars),
h AS (SELECT row_id, prefix, row_number() OVER (PARTITION BY row_id ORDER BY length(prefix) DESC) AS rn FROM r JOIN p USING (mk) WHERE txt = prefix OR starts_with(txt, prefix || ' '))
SELECT r.row_id, h.prefix AS matched_prefix FROM r LEFT JOIN h ON r.row_id = h.row_id AND rn = 1
""")
def longest_prefix_match(t: Tables):
    """The longest model name that begins a listing's model and trim text, within its make."""
    up = lambda c: F.upper(F.trim(c))
    p = t.used_cars.filter("make_name IS NOT NULL AND model_name IS NOT NULL").select(up("make_name").alias("mk"), up("model_name").alias("prefix")).distinct()
    r = t.used_cars.select("row_id", up("make_name").alias("mk"), F.concat(up("model_name"), F.lit(" "), F.coalesce(up("trim_name"), F.lit(""))).alias("txt"))
    return J.longest_prefix_join(r, p, ["mk"], "txt", "prefix", ["row_id"]).select("row_id", "matched_prefix")


@q("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
""")
def snapshot_diff(t: Tables):
    a = t.orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = t.orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return J.snapshot_diff(a, b, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@q("""
WITH u AS (SELECT vin, price, mileage, ingested_at, row_id, row_number() OVER (PARTITION BY vin ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM used_cars WHERE vin IS NOT NULL)
SELECT vin, row_id, price, ingested_at FROM u WHERE rn = 1
""")
def upsert_merge(t: Tables):
    """Newest load of each listing (insert or replace by vin)."""
    cars = t.used_cars.filter("vin IS NOT NULL").select("vin", "row_id", "price", "ingested_at")
    rec = cars.withColumn("r", F.struct("ingested_at", "row_id"))
    half = F.pmod(F.xxhash64("row_id"), F.lit(2).cast("bigint"))
    return J.upsert(rec.filter(half == 0), rec.filter(half == 1), ["vin"], "r").select("vin", "row_id", "price", "ingested_at")


@q("""
SELECT o_orderkey, o_orderdate, count(DISTINCT l_linenumber)::BIGINT AS n_lines, max(l_shipdate) AS last_ship, coalesce(max(l_shipdate) > o_orderdate + INTERVAL 60 DAY, false) AS late_event
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
""")
def exposure_after_proxy(t: Tables):
    """Latest event per key against a date proxy; events are aggregated before the join."""
    ev = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    j = FR.latest_event(t.orders.select("o_orderkey", "o_orderdate"), ev, ["o_orderkey"], "l_shipdate", "l_linenumber", F.expr("o_orderdate + interval 60 days"))
    return j.select("o_orderkey", "o_orderdate", F.col("n_events").alias("n_lines"), F.col("last_event").alias("last_ship"), "late_event")


@q("""
WITH b AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(b.k, s.k) AS k, n_customers::BIGINT AS n_customers, n_suppliers::BIGINT AS n_suppliers FROM b FULL JOIN s ON b.k = s.k
""")
def full_feature_join(t: Tables):
    """Full outer join of feature blocks; a missing block stays null, not zero."""
    b = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    s = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return FR.outer_features([b, s], ["k"])


@q("""
SELECT coalesce(a.g, b.g) AS g, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b
FROM (SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS g, count(*) AS n_a FROM part GROUP BY 1) a
JOIN (SELECT CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN NULL ELSE p_size END AS g, count(*) AS n_b FROM part GROUP BY 1) b ON a.g IS NOT DISTINCT FROM b.g
""")
def null_safe_join(t: Tables):
    """Join on keys where null equals null."""
    s = F.col("p_size")
    a = t.part.groupBy(F.when(s % 7 != 0, s).alias("g")).agg(F.count("*").alias("n_a"))
    b = t.part.groupBy(F.when((s % 5 != 0) & (s % 7 != 0), s).alias("g2")).agg(F.count("*").alias("n_b"))
    return a.join(b, a["g"].eqNullSafe(b["g2"])).select("g", "n_a", "n_b")


@q("""
SELECT feed, city, count(*)::BIGINT AS n FROM used_cars
WHERE coalesce(body_type IN ('Sedan', 'SUV / Crossover'), false) AND coalesce(price BETWEEN 5000 AND 60000, false) AND coalesce(mileage <= 120000, false)
GROUP BY ALL
""")
def faceted_listings(t: Tables):
    f = C.Filters({"body_type": ("Sedan", "SUV / Crossover")}, {"price": 5000}, {"price": 60000, "mileage": 120000})
    return t.used_cars.filter(f.expression()).groupBy("feed", "city").agg(F.count("*").alias("n"))


@q("""
SELECT (floor(price / 25000) * 25000)::DOUBLE AS band, CASE WHEN price >= 100000 THEN '100k+' ELSE 'below' END AS tier, count(*)::BIGINT AS n,
 round(sum(least(greatest(price / 50000.0, 1), 5)), 6) AS weight FROM used_cars WHERE price IS NOT NULL GROUP BY ALL
""")
def price_bands(t: Tables):
    p = F.col("price")
    return t.used_cars.filter("price IS NOT NULL").groupBy(left_closed_band(p, 25000).alias("band"), F.when(p >= 100000, "100k+").otherwise("below").alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum(F.least(F.greatest(p / 50000.0, F.lit(1.0)), F.lit(5.0))), 6).alias("weight"))


@q("""
SELECT upper(regexp_replace(trim(make_name), '\\s+', ' ', 'g')) AS make_key, count(*)::BIGINT AS n, count(DISTINCT make_name)::BIGINT AS spellings FROM used_cars GROUP BY 1
""".replace("\\\\", "\\"))
def make_keys(t: Tables):
    return t.used_cars.groupBy(norm_key(F.col("make_name")).alias("make_key")).agg(F.count("*").alias("n"), F.count_distinct("make_name").alias("spellings"))


@q("""
SELECT o_custkey, count(*)::BIGINT AS n_orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1
""")
def anti_join(t: Tables):
    out = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(out, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))


@q("""
SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1
""")
def semi_join(t: Tables):
    big = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@q("""
SELECT l.l_orderkey, count(*)::BIGINT AS n_items, (count(*) - (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey))::BIGINT AS expansion
FROM lineitem l JOIN part ON l_partkey = p_partkey GROUP BY l.l_orderkey
""")
def join_expansion(t: Tables):
    """Rows a join adds per key (0 where it keeps the grain)."""
    return FR.expansion_audit(t.lineitem, t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey"), ["l_orderkey"])
