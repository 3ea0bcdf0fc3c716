"""Queries of the reusable frame and report operators that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as FR
from ..operators import reports as RP
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
WITH g AS (SELECT make_name, count(*) AS n, count(horsepower) AS h, count(transmission) AS t, count(major_options) AS o FROM used_cars GROUP BY 1)
SELECT make_name, 'horsepower' AS dimension, n::BIGINT AS n, h::BIGINT AS observed, round(h / n, 9) AS share FROM g UNION ALL SELECT make_name, 'transmission', n::BIGINT, t::BIGINT, round(t / n, 9) FROM g UNION ALL SELECT make_name, 'major_options', n::BIGINT, o::BIGINT, round(o / n, 9) FROM g
""")
def coverage_inventory(t: Tables):
    """How far each field is filled per make."""
    return RP.coverage(t.used_cars, ["make_name"], ["horsepower", "transmission", "major_options"])


@q("""
WITH p AS (SELECT o_custkey, o_totalprice - s.v AS e, o_totalprice FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, count(*) AS n, sum(e * e) AS s FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, o_custkey) AS place, sum(s) OVER () AS total FROM g)
SELECT place::BIGINT AS place, o_custkey, n::BIGINT AS n, round(s / total, 6) AS share, round(sum(s) OVER (ORDER BY place) / total, 6) AS running_share FROM r WHERE place <= 20 ORDER BY place
""")
def error_families(t: Tables):
    """The twenty customers with most squared error (a top-k report)."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("v"))
    return RP.error_families(t.orders.join(s, "o_orderkey").withColumn("e", F.col("o_totalprice") - F.col("v")), "o_custkey", "e", 20)


@q("""
WITH p AS (SELECT o_totalprice, o_totalprice - s.v AS e FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey),
g AS (SELECT (floor(o_totalprice / 50000) * 50000)::DOUBLE AS bin, count(*) AS n, sum(e * e) AS s FROM p GROUP BY 1)
SELECT bin, n::BIGINT AS n, round(s / (SELECT sum(s) FROM g), 6) AS share FROM g
""")
def error_bins(t: Tables):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("v"))
    return RP.error_bins(t.orders.join(s, "o_orderkey").withColumn("e", F.col("o_totalprice") - F.col("v")), "o_totalprice", "e", 50000)


@q("""
WITH p AS (SELECT l_orderkey AS card, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'final' END AS a, bool_and(l_quantity < 45) AS good FROM lineitem GROUP BY ALL),
s AS (SELECT card, (max(good::INT) FILTER (a = 'open'))::INT AS base_good, (max(good::INT) FILTER (a = 'final'))::INT AS other_good FROM p GROUP BY 1)
SELECT card, base_good, other_good, other_good - base_good AS delta FROM s WHERE base_good IS NOT NULL AND other_good IS NOT NULL
""")
def review_cards(t: Tables):
    """Cards that are good only if all of their items are, under two approaches."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("card"), F.when(F.col("l_linestatus") == "O", "open").otherwise("final").alias("a"), "l_linenumber", "l_quantity")
    return RP.review_scores(rows, "card", "a", "l_linenumber", F.col("l_quantity") < 45, "open", "final")


@q("""
WITH c AS (SELECT count(*) AS n, count(horsepower) AS h, count(theft_title) AS s, count(feed) AS f, count(DISTINCT horsepower) AS lh, count(DISTINCT theft_title) AS ls, count(DISTINCT feed) AS lf FROM used_cars)
SELECT 'horsepower' AS field, round(h / n, 9) AS coverage, lh > 1 AS varies, h / n >= 0.7 AND lh > 1 AS usable FROM c UNION ALL SELECT 'theft_title', round(s / n, 9), ls > 1, s / n >= 0.7 AND ls > 1 FROM c UNION ALL SELECT 'feed', round(f / n, 9), lf > 1, f / n >= 0.7 AND lf > 1 FROM c
""")
def selected_fields(t: Tables):
    return RP.select_fields(t.used_cars, ["horsepower", "theft_title", "feed"])


@q("""
WITH s AS (SELECT o_orderkey, o_orderpriority, coalesce(o_totalprice > 50000, false) AS large_ok, coalesce(o_orderstatus <> 'P', false) AS settled_ok FROM orders)
SELECT o_orderkey, concat_ws(';', CASE WHEN NOT large_ok THEN 'large' END, CASE WHEN NOT settled_ok THEN 'settled' END) AS failed, large_ok AND settled_ok AS eligible FROM s
""")
def eligibility_rules(t: Tables):
    """Rows with the rules they fail."""
    return FR.eligibility(t.orders, {"large": F.col("o_totalprice") > 50000, "settled": F.col("o_orderstatus") != "P"}).select("o_orderkey", "failed", "eligible")


@q("""
SELECT o.o_orderkey, concat_ws(';', CASE WHEN o.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_totalprice IS DISTINCT FROM c.p THEN 'o_totalprice' END) AS changed
FROM orders o JOIN (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 11 <> 0) c USING (o_orderkey) WHERE o.o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'gone' FROM orders WHERE o_orderkey % 11 = 0
""")
def frozen_changes(t: Tables):
    """Frozen rows whose source has other values now, or none. (The source is the table with every seventh price
    raised and every eleventh row gone.)"""
    now = t.orders.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return FR.changed_attributes(t.orders, now, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@q()
def strata_sample(t: Tables):
    """Five hundred comments (a sampling operator): fixed shares of languages, four of a video, every text once."""
    rows = t.youtube_comments_sentiment.join(t.comments.groupBy(F.col("id").alias("comment_id")).agg(F.max("sentiment").alias("sentiment")), "comment_id")
    return FR.strata_sample(rows.select("row_id", "video_id", "text", "sentiment"), "row_id", "sentiment", {"positive": 0.3, "negative": 0.2, "neutral": 0.5}, 500, "video_id", 4, "text").select("row_id", "sentiment")
