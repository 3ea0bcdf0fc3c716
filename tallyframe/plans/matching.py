"""Join, set and peer queries of the second wave."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import hash_unit
from ..operators import joins as J
from ..operators import peers as P
from ..operators import frames as FR
from ..operators import reports as RP
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q(r"""
SELECT count(*)::BIGINT AS candidates, count(DISTINCT a.row_id)::BIGINT AS listings FROM used_cars a JOIN (SELECT DISTINCT upper(trim(make_name)) AS mk, upper(trim(model_name)) AS prefix FROM used_cars WHERE make_name IS NOT NULL AND model_name IS NOT NULL) p
 ON upper(trim(a.make_name)) = p.mk AND (upper(trim(a.model_name)) = prefix OR starts_with(upper(trim(a.model_name)), prefix || ' '))
""")
def prefix_candidates(t: Tables):
    """All names that begin a listing's model within its make."""
    up = lambda c: F.upper(F.trim(c))
    p = t.used_cars.filter("make_name IS NOT NULL AND model_name IS NOT NULL").select(up("make_name").alias("mk"), up("model_name").alias("prefix")).distinct()
    a = t.used_cars.select("row_id", up("make_name").alias("mk"), up("model_name").alias("md"))
    j = J.prefix_join(a, p, ["mk"], "md", "prefix")
    return j.agg(F.count("*").alias("candidates"), F.count_distinct("row_id").alias("listings"))


@q(r"""
WITH d(lo, hi, label) AS (VALUES (1, 20, 'small'), (15, 35, 'mid'), (30, 50, 'large')), h AS (SELECT p_partkey, count(DISTINCT label) AS k, min(label) AS l FROM part LEFT JOIN d ON p_size BETWEEN lo AND hi GROUP BY 1)
SELECT p_partkey, CASE WHEN k = 1 THEN l END AS label, CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'assigned' ELSE 'conflict' END AS state FROM h
""")
def range_labels(t: Tables):
    """Labels by ranges that abstain where two disagree."""
    d = t.spark.createDataFrame([(1, 20, "small"), (15, 35, "mid"), (30, 50, "large")], "lo int, hi int, label string")
    j = J.range_join(t.part.select("p_partkey", "p_size"), d, [], "p_size", "lo", "hi", bucket=10)
    h = j.groupBy("p_partkey").agg(F.count_distinct("label").alias("k"), F.min("label").alias("l"))
    return h.select("p_partkey", F.when(F.col("k") == 1, F.col("l")).alias("label"), F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "assigned").otherwise("conflict").alias("state"))


@q(r"""
SELECT row_id FROM youtube_comments_sentiment c WHERE comment_id IS NOT NULL AND comment_id NOT IN (SELECT id FROM comments WHERE eligible = 0 AND id IS NOT NULL) AND video_id NOT IN (SELECT video FROM comments WHERE sentiment = 'negative' AND truncated = 1 AND video IS NOT NULL)
 AND ('0x' || substr(sha256('42|' || comment_id), 1, 13))::BIGINT / 4503599627370496.0 >= 0.1
""")
def protected_rows(t: Tables):
    """Rows that are in no protected list and not reserved by their hash."""
    ids = t.comments.filter("eligible = 0").select("id")
    vids = t.comments.filter("sentiment = 'negative' AND truncated = 1").select("video")
    return FR.unprotected(t.youtube_comments_sentiment, {"comment_id": ids, "video_id": vids}, "comment_id", 0.1).select("row_id")


@q(r"""
WITH v AS (SELECT record_key, count(DISTINCT sha256(coalesce(make, '') || '|' || coalesce(model, ''))) AS families, count(DISTINCT md5(record_json)) AS versions FROM nhtsa_complaints GROUP BY 1)
SELECT record_key, families::BIGINT AS families, versions::BIGINT AS versions, CASE WHEN families > 1 THEN 'several_families' WHEN versions > 1 THEN 'conflict' ELSE 'kept' END AS state FROM v
""")
def version_hashes(t: Tables):
    """Records with several versions or families, by payload digests."""
    return FR.version_states(t.nhtsa_complaints, "record_key", ["make", "model"], "record_json")


@q(r"""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND a.v <> b.v THEN NULL ELSE coalesce(a.v, b.v) END AS v, coalesce(a.v <> b.v, false) AS conflict FROM a FULL JOIN b ON a.k = b.k
""")
def annotation_merge(t: Tables):
    """Two annotators' labels merged; conflicts are flagged and left open."""
    a = t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    b = t.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 1, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return FR.merge_annotations(a, b, "k", "v")


@q(r"""
SELECT DISTINCT ON (h) h, doc_id FROM (SELECT md5(lower(text)) AS h, doc_id FROM documents WHERE text IS NOT NULL) ORDER BY h, doc_id
""")
def distinct_on(t: Tables):
    """First row of each case-folded text."""
    return FR.first_of(t.documents, F.md5(F.lower("text")), "doc_id")


@q(r"""
SELECT DISTINCT make_name, body_type FROM used_cars
""")
def distinct_rows(t: Tables):
    return t.used_cars.select("make_name", "body_type").distinct()


@q(r"""
WITH i AS (SELECT upper(n_name) AS k, n_nationkey FROM nation UNION SELECT 'R' || n_regionkey::VARCHAR || '-' || upper(n_name), n_nationkey FROM nation) SELECT k, count(c_custkey)::BIGINT AS n FROM i LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def two_key_index(t: Tables):
    """An index over two spellings of a key, joined once."""
    spellings = [F.upper("n_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("-"), F.upper("n_name"))]
    i = FR.keyed_by_any(t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), spellings, "c_nationkey")
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("m"))
    return i.join(n, "c_nationkey", "left").groupBy("k").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


@q(r"""
WITH p AS (SELECT p_brand || '|' || p_type AS id, p_brand AS fam, p_type AS kind, round(avg(p_size), 6) AS size, count(*) AS n FROM part GROUP BY p_brand, p_type), q AS (SELECT a.id, b.id AS peer, round(abs(a.size - b.size), 9) AS d FROM p a JOIN p b ON a.kind = b.kind AND a.fam <> b.fam AND abs(a.size - b.size) <= 2)
SELECT id, count(*)::BIGINT AS within_window, min(d) AS nearest FROM q GROUP BY 1
""")
def window_candidates(t: Tables):
    """Candidates of a non-equi self-join, bucketed by the window."""
    p = t.part.groupBy("p_brand", "p_type").agg(F.round(F.avg("p_size"), 6).alias("size"))
    p = p.select(F.concat_ws("|", "p_brand", "p_type").alias("id"), F.col("p_brand").alias("fam"), F.col("p_type").alias("kind"), "size")
    c = P.candidate_pairs(p, "id", "fam", ["kind"], "size", 2, [])
    return c.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("within_window"), F.min(F.round(F.abs(F.col("a_size") - F.col("b_size")), 9)).alias("nearest"))


@q(r"""
WITH c AS (SELECT c_nationkey, count(*) AS n, quantile_cont(c_acctbal, 0.5) AS med, arg_min(c_custkey, (c_acctbal, c_custkey)) AS example, min(c_acctbal) AS cheapest FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT n_name, n::BIGINT AS n, round(med, 6) AS med, example, cheapest FROM nation JOIN c ON n_nationkey = c_nationkey
""")
def market_rows(t: Tables):
    """Market of each profile with its cheapest example; aggregated before the join."""
    m = FR.group_market(t.nation.select("n_name", F.col("n_nationkey").alias("c_nationkey")), t.customer, ["c_nationkey"], "c_acctbal", "c_custkey")
    return m.select("n_name", "n", F.col("median").alias("med"), "example", "cheapest")


@q(r"""
WITH s AS (SELECT l_partkey, l_suppkey, max(l_extendedprice / l_quantity) AS u FROM lineitem GROUP BY ALL), m AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS k FROM s)
SELECT l_partkey, count(*)::BIGINT AS sources, count(DISTINCT round(u, 2)) = 1 AS unanimous FROM m WHERE k >= 3 GROUP BY 1
""")
def unanimous_values(t: Tables):
    """Groups of at least three sources, and whether they agree."""
    s = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return s.groupBy("l_partkey").agg(F.count("*").alias("sources"), (F.count_distinct(F.round("u", 2)) == 1).alias("unanimous")).filter("sources >= 3")


@q(r"""
WITH e AS (SELECT r.row_id, r.make_name, c.eligible FROM (SELECT row_id, make_name, year FROM used_cars) r LEFT JOIN (SELECT make_name AS m, year AS y, count(*) >= 25 AS eligible FROM used_cars GROUP BY ALL) c ON r.make_name = c.m AND r.year = c.y)
SELECT make_name, count(*)::BIGINT AS n, count(*) FILTER (eligible)::BIGINT AS eligible, count(*) FILTER (eligible IS NULL)::BIGINT AS unknown FROM e GROUP BY 1
""")
def eligible_rows(t: Tables):
    """Rows whose group has support; groups with a null key are unknown, not unsupported."""
    j = FR.supported_rows(t.used_cars.select("row_id", "make_name", "year"), ["make_name", "year"], 25)
    return j.groupBy("make_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("eligible"), 1)).alias("eligible"), F.count(F.when(F.col("eligible").isNull(), 1)).alias("unknown"))


@q(r"""
WITH f AS (SELECT o_orderkey, (('0x' || substr(sha256('42|' || o_custkey::VARCHAR), 1, 15))::BIGINT % 5) AS fold, o_totalprice FROM orders), m AS (SELECT fold, avg(o_totalprice) AS m FROM f GROUP BY 1), t AS (SELECT sum(o_totalprice) AS s, count(*) AS n FROM f), o AS (SELECT fold, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1)
SELECT o_orderkey, f.fold::BIGINT AS fold, round((t.s - o.s) / (t.n - o.n), 4) AS out_of_fold FROM f JOIN o ON f.fold = o.fold, t
""")
def out_of_fold_means(t: Tables):
    """A prediction for every row that doesn't use its own fold."""
    from ..functions.expr import hash_mod

    f = t.orders.select("o_orderkey", hash_mod("o_custkey", 5).alias("fold"), "o_totalprice")
    o = f.groupBy("fold").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    allw = W.partitionBy()
    o = o.select("fold", F.round((F.sum("s").over(allw) - F.col("s")) / (F.sum("n").over(allw) - F.col("n")), 4).alias("out_of_fold"))
    return f.join(F.broadcast(o), "fold").select("o_orderkey", "fold", "out_of_fold")


@q(r"""
WITH p AS (SELECT o_orderkey, (('0x' || substr(sha256('42|' || o_custkey::VARCHAR), 1, 15))::BIGINT % 5)::BIGINT AS fold FROM orders WHERE o_orderkey % 13 <> 0)
SELECT 'missing' AS issue, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p) UNION ALL SELECT 'repeated', count(*) FROM (SELECT o_orderkey FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'bad_fold', count(*) FROM p WHERE fold NOT BETWEEN 0 AND 4
""")
def fold_coverage(t: Tables):
    """Whether every row has exactly one out-of-fold row."""
    from ..functions.expr import hash_mod

    p = t.orders.filter("o_orderkey % 13 <> 0").select("o_orderkey", hash_mod("o_custkey", 5).alias("fold"))
    return RP.fold_coverage(t.orders, p, "o_orderkey", "fold", 5)


@q(r"""
WITH d AS (SELECT DISTINCT fuel_type, wheel_system FROM used_cars), m AS (SELECT *, lower(coalesce(fuel_type, '')) || '/' || coalesce(wheel_system, '?') AS label FROM d)
SELECT row_id, label FROM used_cars u JOIN m ON u.fuel_type IS NOT DISTINCT FROM m.fuel_type AND u.wheel_system IS NOT DISTINCT FROM m.wheel_system
""")
def mapped_distinct(t: Tables):
    """An expensive mapping evaluated per distinct tuple and joined back null-safe."""
    label = lambda d: d.withColumn("label", F.concat(F.lower(F.coalesce("fuel_type", F.lit(""))), F.lit("/"), F.coalesce("wheel_system", F.lit("?"))))
    return FR.mapped_distinct(t.used_cars.select("row_id", "fuel_type", "wheel_system"), ["fuel_type", "wheel_system"], label).select("row_id", "label")
