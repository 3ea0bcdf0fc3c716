"""Aggregation and window queries of the second wave."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import sha_hex, with_row
from ..operators import peers as P
from ..operators import sampling as S
from ..operators import frames as FR
from ..operators import reports as RP
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q(r"""
WITH l AS (SELECT user_id, unnest(['t' || (event_id % 3)::VARCHAR, 't' || (event_id % 5)::VARCHAR]) AS topic, value FROM events), per AS (SELECT topic, user_id, avg(value) AS m, count(*) AS n FROM l GROUP BY ALL)
SELECT topic, count(*)::BIGINT AS units, sum(n)::BIGINT AS n, round(avg(m), 6) AS mean_of_means FROM per GROUP BY 1
""")
def topic_means(t: Tables):
    """Topics exploded from arrays, then means of the units' means."""
    topics = F.array(F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")))
    l = t.events.select("user_id", "value", F.explode(topics).alias("topic"))
    per = l.groupBy("topic", "user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return per.groupBy("topic").agg(F.count("*").alias("units"), F.sum("n").alias("n"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@q(r"""
WITH i AS (SELECT user_id, event_type, bool_or(value > 90) AS hot, bool_or(props LIKE '%1%') AS one FROM events GROUP BY ALL) SELECT event_type, round(avg(hot::INT), 9) AS hot_share, round(avg(one::INT), 9) AS one_share, count(*)::BIGINT AS n FROM i GROUP BY 1
""")
def incident_union(t: Tables):
    """Flags united per incident before their shares are taken."""
    return RP.united_shares(t.events, ["user_id"], ["event_type"], {"hot": F.col("value") > 90, "one": F.col("props").contains("1")}).drop("supported")


@q(r"""
WITH c AS (SELECT c_nationkey AS family, c_mktsegment AS cluster, count(*) AS n, sum(c_acctbal) AS w FROM customer GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY family) AS share, w / sum(w) OVER (PARTITION BY family) AS wshare FROM c)
SELECT family, round(max(share), 9) AS top_share, round(sum(share * share), 9) AS concentration, arg_max(cluster, (share, cluster)) AS top_cluster, round(max(wshare), 6) AS top_weighted FROM s GROUP BY 1
""")
def family_mixtures(t: Tables):
    """Shares of clusters inside families, their concentration and the largest."""
    rows = t.customer.select(F.col("c_nationkey").alias("family"), F.col("c_mktsegment").alias("cluster"), "c_acctbal")
    return RP.mixtures(rows, "family", "cluster", "c_acctbal")


@q(r"""
WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS mp, quantile_cont(p_size, 0.5) AS ms FROM part GROUP BY 1),
d AS (SELECT p_partkey, part.p_brand, round((abs(p_retailprice - mp) / mp + abs(p_size - ms) / ms) / 2, 9) AS d FROM part JOIN m USING (p_brand))
SELECT p_brand, arg_min(p_partkey, (d, p_partkey)) AS p_partkey, min(d) AS deviation FROM d GROUP BY 1
""")
def representative_rows(t: Tables):
    """The row nearest to its group's medians."""
    m = t.part.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("mp"), F.percentile("p_size", 0.5).alias("ms"))
    d = t.part.join(m, "p_brand").withColumn("d", F.round((F.abs(F.col("p_retailprice") - F.col("mp")) / F.col("mp") + F.abs(F.col("p_size") - F.col("ms")) / F.col("ms")) / 2, 9))
    return d.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("d", "p_partkey")).alias("p_partkey"), F.min("d").alias("deviation"))


@q(r"""
WITH g AS (SELECT * FROM (VALUES ('1-URGENT'), ('5-LOW'), ('9-NONE')) a(pr), (VALUES ('all'), ('100k+'), ('below')) b(tier)),
r AS (SELECT o_orderpriority AS pr, unnest(['all', CASE WHEN o_totalprice >= 100000 THEN '100k+' ELSE 'below' END]) AS tier, o_totalprice FROM orders)
SELECT g.pr, g.tier, count(r.pr)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, CASE WHEN count(r.pr) = 0 THEN 'no_rows' ELSE 'ok' END AS status FROM g LEFT JOIN r ON g.pr = r.pr AND g.tier = r.tier GROUP BY ALL
""")
def requested_segments(t: Tables):
    """Segments asked for, with a row also where there is no data."""
    grid = t.spark.createDataFrame([(p, x) for p in ("1-URGENT", "5-LOW", "9-NONE") for x in ("all", "100k+", "below")], "pr string, tier string")
    tiers = F.array(F.lit("all"), F.when(F.col("o_totalprice") >= 100000, "100k+").otherwise("below"))
    return RP.requested(t.orders.select(F.col("o_orderpriority").alias("pr"), F.explode(tiers).alias("tier"), "o_totalprice"), grid, ["pr", "tier"], "o_totalprice")


@q(r"""
WITH x AS (SELECT feed, CASE WHEN price > 0 THEN ln(1 + price) END AS y FROM used_cars), s AS (SELECT feed, quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0]) AS v FROM x WHERE y IS NOT NULL GROUP BY 1)
SELECT feed, round(v[1], 6) AS low, round(v[2], 6) AS q25, round(v[3], 6) AS median, round(v[4], 6) AS q75, round(v[5], 6) AS high, round(v[4] + 1.5 * (v[4] - v[2]), 6) AS upper_fence FROM s
""")
def five_numbers(t: Tables):
    """Five-number summary of a log, with the upper fence."""
    return RP.log_summary(t.used_cars, "feed", "price")


@q(r"""
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(60, floor((o_totalprice - lo) / ((hi - lo) / 60)) + 1)::BIGINT AS bin, count(*)::BIGINT AS n FROM orders, b GROUP BY 1
""")
def equal_bins(t: Tables):
    """Sixty bins between the ends of a column."""
    return RP.equal_bins(t.orders, "o_totalprice", 60)


@q(r"""
SELECT CASE WHEN length(text) = 0 THEN '0' WHEN length(text) < 200 THEN '1-199' WHEN length(text) < 1000 THEN '200-999' ELSE '1000+' END AS band, strftime(committed_at, '%Y-%m') AS month, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL
""")
def length_bands(t: Tables):
    n = F.char_length("text")
    band = F.when(n == 0, "0").when(n < 200, "1-199").when(n < 1000, "200-999").otherwise("1000+")
    return t.documents.filter("text IS NOT NULL").groupBy(band.alias("band"), F.date_format("committed_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@q(r"""
SELECT make_name, min(year) AS first_year, max(year) AS last_year, count(DISTINCT vin)::BIGINT AS vins, count(DISTINCT model_name)::BIGINT AS models FROM used_cars GROUP BY 1 ORDER BY vins DESC, make_name LIMIT 40
""")
def task_inventory(t: Tables):
    """Work list: ranges and counts per group, the largest first (a top-k report)."""
    g = RP.task_inventory(t.used_cars, "make_name", "year", "vin", "model_name", 40)
    return g.select("make_name", "first_year", "last_year", F.col("n_ids").alias("vins"), F.col("n_inner").alias("models"))


@q(r"""
WITH c AS (SELECT label AS a, vec_id % 6 AS b, count(*) AS n FROM embeddings GROUP BY ALL), ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS rb FROM c GROUP BY 1), j AS (SELECT c.a, c.b, n / (ra + rb - n) AS jac FROM c JOIN ra USING (a) JOIN rb USING (b))
SELECT a, arg_max(b, (jac, -b)) AS b, round(max(jac), 9) AS jaccard FROM j GROUP BY 1
""")
def cluster_overlap(t: Tables):
    """Best matching cluster of another labeling, by Jaccard."""
    return RP.best_overlap(t.embeddings.select(F.col("label").alias("a"), (F.col("vec_id") % 6).alias("b")), "a", "b")


@q(r"""
WITH f AS (SELECT l_linenumber AS layer, l_orderkey % 5 AS fold, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS ok, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT layer, sum(ok)::BIGINT AS correct, sum(n)::BIGINT AS emitted, round(sum(ok) / sum(n), 9) AS agreement, sum(n) >= 10 AND sum(ok) / sum(n) >= 0.25 AS deploy FROM f GROUP BY 1
""")
def pooled_agreement(t: Tables):
    """Agreement pooled over folds, and the gate on it."""
    ok = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    return RP.pooled_agreement(t.lineitem.select(F.col("l_linenumber").alias("layer"), (F.col("l_orderkey") % 5).alias("fold"), "l_returnflag", "l_linestatus"), ["layer"], "fold", ok, 10, 0.25)


@q(r"""
WITH m AS (SELECT 'a' AS run, avg(abs(o_totalprice - 100000)) AS mae FROM orders UNION ALL SELECT 'b', avg(abs(o_totalprice - 150000)) FROM orders UNION ALL SELECT 'c', avg(abs(o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))) FROM orders)
SELECT run, round(mae, 4) AS mae, row_number() OVER (ORDER BY mae, run)::BIGINT AS place FROM m
""")
def run_comparison(t: Tables):
    """Metric tables of several runs stacked and ranked; the last is the median baseline."""
    med = with_row(t.orders, t.orders.agg(F.percentile("o_totalprice", 0.5).alias("v")))
    return RP.compare_runs({"a": t.orders.withColumn("e", F.col("o_totalprice") - 100000), "b": t.orders.withColumn("e", F.col("o_totalprice") - 150000), "c": med.withColumn("e", F.col("o_totalprice") - F.col("v"))}, "e")


@q(r"""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('42|' || o_orderkey::VARCHAR), o_orderkey) AS r, sha256('42|' || o_custkey::VARCHAR) AS vh FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE r <= 3 ORDER BY r, vh, o_orderkey LIMIT 500
""")
def rotated_sample(t: Tables):
    """Lowest hashes per key (three of each, the rule of this sample), taken in turns."""
    w = W.partitionBy("o_custkey").orderBy(sha_hex("o_orderkey", salt="42"), "o_orderkey")
    r = t.orders.select("o_orderkey", "o_custkey").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return r.withColumn("vh", sha_hex("o_custkey", salt="42")).orderBy("r", "vh", "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


@q(r"""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('42|' || c_custkey::VARCHAR), c_custkey) AS r, sha256('42|' || c_custkey::VARCHAR) AS h FROM customer)
SELECT c_custkey, c_mktsegment FROM r ORDER BY r, c_mktsegment, h LIMIT 120
""")
def water_filled_sample(t: Tables):
    """Equal quotas over strata, capped by what each has: rank within the stratum is the water level."""
    w = W.partitionBy("c_mktsegment", "c_nationkey").orderBy(sha_hex("c_custkey", salt="42"), "c_custkey")
    r = t.customer.select("c_custkey", "c_mktsegment", F.row_number().over(w).alias("r"), sha_hex("c_custkey", salt="42").alias("h"))
    return r.orderBy("r", "c_mktsegment", "h").limit(120).select("c_custkey", "c_mktsegment")


@q(r"""
SELECT l_orderkey, l_linenumber, l_shipdate, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS first_ship FROM lineitem
""")
def first_dates(t: Tables):
    """First date of a key on all its rows; aggregated, then joined back."""
    return FR.with_group_min(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey", "l_shipdate", "first_ship")


@q(r"""
WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, o_orderdate FROM r WHERE i % 40 = 0
""")
def every_nth(t: Tables):
    """Every fortieth row of each year in time order (a sampling operator)."""
    rows = t.orders.select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    ranked = S.split_rank(rows, ["y"], F.dayofyear("o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "r")
    return ranked.filter("(r - 1) % 40 = 0").select("o_orderkey", "o_orderdate")


@q(r"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), lead AS (SELECT * FROM l WHERE r = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 40), rest AS (SELECT * FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM lead) ORDER BY c_acctbal DESC, c_custkey LIMIT 40)
SELECT c_custkey, c_nationkey FROM (SELECT *, 0 AS o FROM lead UNION ALL SELECT *, 1 FROM rest) ORDER BY o, c_acctbal DESC, c_custkey LIMIT 40
""")
def leader_fill(t: Tables):
    """One leader per group, then the best of the rest until the list is full."""
    return P.diverse_top(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 40).select("c_custkey", "c_nationkey")


@q(r"""
SELECT p_brand, count(*)::BIGINT AS n, round(corr(p_size, p_retailprice), 6) AS r, count(*) FILTER (p_size IS NOT NULL)::DOUBLE / count(*) >= 0.7 AND count(DISTINCT p_size) > 1 AS usable FROM part GROUP BY 1
""")
def field_selection(t: Tables):
    """Coverage, levels and correlation that decide whether a field is used."""
    cov = F.count("p_size") / F.count("*")
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"), ((cov >= 0.7) & (F.count_distinct("p_size") > 1)).alias("usable"))


@q(r"""
WITH g AS (SELECT o_custkey, avg(abs(o_totalprice - 150000)) AS m FROM orders GROUP BY 1) SELECT count(*)::BIGINT AS groups, round(avg(m), 4) AS macro_mae, round((SELECT avg(abs(o_totalprice - 150000)) FROM orders), 4) AS micro_mae FROM g
""")
def macro_error(t: Tables):
    """Mean of the groups' errors beside the error over all rows."""
    return RP.macro_error(t.orders, "o_custkey", F.abs(F.col("o_totalprice") - 150000))
