"""Profile and peer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peers as P
from ..operators import profiles as PR
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
SELECT p_brand, p_type, count(*)::BIGINT AS n, quantile_cont(p_retailprice, 0.5) AS p_retailprice_median, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 9) AS p_retailprice_iqr,
 min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max, count(p_retailprice)::BIGINT AS p_retailprice_n FROM part GROUP BY ALL
""")
def profile_aggregate(t: Tables):
    return PR.numeric_profile(t.part, ["p_brand", "p_type"], ["p_retailprice"])


@q("""
WITH c AS (SELECT make_name, body_type, count(*) AS n FROM used_cars WHERE body_type IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY make_name ORDER BY n DESC, body_type) AS rn, sum(n) OVER (PARTITION BY make_name) AS o FROM c)
SELECT make_name, body_type AS mode_value, n::BIGINT AS mode_n, o::BIGINT AS observed, round(n / o, 9) AS agreement, CASE WHEN round(n / o, 9) >= 0.9 THEN body_type END AS agreed FROM r WHERE rn = 1
""")
def mode_agreement(t: Tables):
    """Most frequent label and its agreement; exposed only from the gate on."""
    m = PR.modes(t.used_cars, ["make_name"], "body_type")
    return m.withColumn("agreed", PR.agreed(F.col("mode_value"), F.col("agreement")))


@q("""
WITH l AS (SELECT make_name, model_name, fuel_type, CASE WHEN count(DISTINCT body_type) > 1 THEN 'conflicting' ELSE coalesce(max(body_type), 'unknown') END AS label, count(*) AS w FROM used_cars WHERE model_name IS NOT NULL GROUP BY ALL),
c AS (SELECT make_name, model_name, label, sum(w) AS w FROM l GROUP BY ALL),
g AS (SELECT make_name, model_name, sum(w)::BIGINT AS weight, (count(*) FILTER (label NOT IN ('unknown', 'conflicting')))::BIGINT AS known_labels, max(label) FILTER (label NOT IN ('unknown', 'conflicting')) AS one, max(w) FILTER (label NOT IN ('unknown', 'conflicting')) AS top, bool_or(label = 'conflicting') AS clash FROM c GROUP BY ALL),
s AS (SELECT *, CASE WHEN clash THEN 'conflicting' WHEN known_labels > 1 THEN 'mixed' WHEN known_labels = 1 AND top / weight >= 0.9 THEN 'assigned' ELSE 'insufficient_evidence' END AS state FROM g)
SELECT make_name, model_name, weight, known_labels, CASE WHEN state = 'assigned' THEN one END AS assigned_label, state FROM s
""")
def parent_state(t: Tables):
    """State of each model by the bodies of its fuel variants; a variant with several bodies conflicts."""
    body = F.when(F.count_distinct("body_type") > 1, "conflicting").otherwise(F.coalesce(F.max("body_type"), F.lit("unknown")))
    parts = t.used_cars.filter("model_name IS NOT NULL").groupBy("make_name", "model_name", "fuel_type").agg(body.alias("label"), F.count("*").alias("w"))
    return PR.parent_state(parts, ["make_name", "model_name"], "label", "w")


@q("""
SELECT make_name, count(*)::BIGINT AS n, string_agg(DISTINCT fuel_type, ';' ORDER BY fuel_type) AS fuels FROM used_cars GROUP BY 1
""")
def label_sets(t: Tables):
    labels = F.array_join(F.array_sort(F.collect_set("fuel_type")), ";")
    return t.used_cars.groupBy("make_name").agg(F.count("*").alias("n"), F.nullif(labels, F.lit("")).alias("fuels"))


@q("""
WITH p AS (SELECT p_type, p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, round(avg(m), 9) AS mean_of_means, count(*)::BIGINT AS inner_groups, sum(n)::BIGINT AS n_rows FROM p GROUP BY 1 HAVING count(*) >= 5
""")
def expert_make_means(t: Tables):
    return PR.mean_of_means(t.part, "p_type", "p_brand", "p_retailprice", 5)


@q("""
WITH s AS (SELECT row_id, city_fuel_economy AS a, highway_fuel_economy AS b FROM used_cars),
r AS (SELECT row_id, CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN b IS NULL THEN 'first_only' WHEN a IS NULL THEN 'second_only' WHEN abs(a - b) <= greatest(5.0, 0.2 * b) THEN 'agree' ELSE 'conflict' END AS state, a, b FROM s)
SELECT row_id, state, CASE WHEN state <> 'conflict' THEN coalesce(a, b) END AS value FROM r
""")
def reconcile_sources(t: Tables):
    """Two sources of a number: agreement within a tolerance, or a state that says why not."""
    value, state = PR.reconcile_numeric(F.col("city_fuel_economy"), F.col("highway_fuel_economy"), 5, 0.2)
    return t.used_cars.select("row_id", state.alias("state"), value.alias("value"))


@q("""
WITH g AS (SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1)
SELECT p_brand, n, round(sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS running_share FROM g
""")
def running_share(t: Tables):
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return PR.running_share(g, [F.col("n").desc(), F.col("p_brand")], "n")




@q("""
WITH prof AS (SELECT p_brand || '|' || p_type AS id, p_brand AS fam, p_type AS kind, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price, round(avg(length(p_name)), 6) AS len FROM part GROUP BY p_brand, p_type),
b AS (SELECT quantile_cont(size, 0.01) AS ls, quantile_cont(size, 0.99) AS hs, quantile_cont(price, 0.01) AS lp, quantile_cont(price, 0.99) AS hp, quantile_cont(len, 0.01) AS ll, quantile_cont(len, 0.99) AS hl FROM prof),
pairs AS (SELECT a.id, c.id AS peer, c.fam AS pf,
  round(((abs(least(greatest(a.size, ls), hs) - least(greatest(c.size, ls), hs)) / (hs - ls) + abs(least(greatest(a.price, lp), hp) - least(greatest(c.price, lp), hp)) / (hp - lp)) / 2
       + abs(least(greatest(a.len, ll), hl) - least(greatest(c.len, ll), hl)) / (hl - ll)) / 2, 9) AS distance
  FROM prof a JOIN prof c ON a.kind = c.kind AND a.fam <> c.fam AND abs(a.size - c.size) <= 3, b),
f AS (SELECT id, peer, distance, row_number() OVER (PARTITION BY id, pf ORDER BY distance, peer) AS rn FROM pairs),
k AS (SELECT id, peer, distance, row_number() OVER (PARTITION BY id ORDER BY distance, peer) AS peer_rank FROM f WHERE rn = 1)
SELECT id, peer, distance, peer_rank::BIGINT AS peer_rank FROM k WHERE peer_rank <= 5
""")
def gower_peers(t: Tables):
    """Five nearest profiles of other families by blockwise mixed-type distance."""
    prof = t.part.groupBy("p_brand", "p_type").agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 6).alias("price"), F.round(F.avg(F.length("p_name")), 6).alias("len"))
    prof = prof.select(F.concat_ws("|", "p_brand", "p_type").alias("id"), F.col("p_brand").alias("fam"), F.col("p_type").alias("kind"), "size", "price", "len")
    return P.nearest_peers(prof, "id", "fam", ["kind"], "size", 3, [(["size", "price"], []), (["len"], [])])


@q("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)::INT AS lead FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM r ORDER BY lead DESC, o_totalprice DESC, o_orderkey LIMIT 50
""")
def diverse_topk(t: Tables):
    return P.diverse_top(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


@q("""
WITH a AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r, 0 AS l FROM orders GROUP BY 1 QUALIFY r <= 40),
b AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r, 1 AS l FROM orders GROUP BY 1 QUALIFY r <= 40),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT id, min((r, l)) AS m FROM u GROUP BY 1)
SELECT id, m[1]::BIGINT AS list_rank, m[2]::BIGINT AS list_no FROM f ORDER BY 2, 3, 1 LIMIT 50
""")
def round_robin_merge(t: Tables):
    from pyspark.sql import Window as W

    per = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.count("*").alias("n"))
    top = lambda c: per.orderBy(F.col(c).desc(), "id").limit(40).withColumn("r", F.row_number().over(W.orderBy(F.col(c).desc(), "id")))
    return P.round_robin([top("s"), top("n")], "id", "r", 50)


@q("""
SELECT p_type, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS p_retailprice FROM part GROUP BY 1
""")
def best_per_family(t: Tables):
    return t.part.groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"), F.min("p_retailprice").alias("p_retailprice"))


@q("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS cosine FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour) AS rank FROM s)
SELECT query_id, neighbour, cosine, rank::BIGINT AS rank FROM r WHERE rank <= 10
""")
def cosine_neighbors(t: Tables):
    """Ten nearest vectors of every query (ids divisible by 50) over all rows."""
    return P.neighbours_of(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@q()
def indexed_neighbors(t: Tables):
    """The same search through an inverted index over all rows (recall is measured in the tests)."""
    return P.indexed_neighbours(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


_CAR_PROFILES = """prof AS (SELECT concat_ws('|', make_name, model_name, year::VARCHAR, body_type) AS id, concat_ws('|', make_name, model_name) AS fam, body_type AS kind, year, round(avg(horsepower), 6) AS hp, round(avg(city_fuel_economy), 6) AS mpg,
  min(fuel_type) AS fuel, min(wheel_system) AS wheels, round(avg(CASE WHEN transmission = 'A' THEN 1.0 ELSE 0.0 END), 6) AS pa, floor(avg(highway_fuel_economy) / 8)::INT AS cl, count(*) >= 2 AS ok
  FROM used_cars WHERE make_name IS NOT NULL AND model_name IS NOT NULL AND year IS NOT NULL AND body_type IS NOT NULL GROUP BY make_name, model_name, year, body_type)"""
_RANKED = f"""
WITH {_CAR_PROFILES}, fit AS (SELECT * FROM prof WHERE ok),
b AS (SELECT quantile_cont(hp, 0.01) AS lh, quantile_cont(hp, 0.99) AS hh, quantile_cont(mpg, 0.01) AS lm, quantile_cont(mpg, 0.99) AS hm FROM fit),
raw AS (SELECT a.id, c.id AS peer, c.fam AS pf, abs(a.year - c.year) AS gap,
  abs(least(greatest(a.hp, lh), hh) - least(greatest(c.hp, lh), hh)) / (hh - lh) AS d1, abs(least(greatest(a.mpg, lm), hm) - least(greatest(c.mpg, lm), hm)) / (hm - lm) AS d2,
  (a.fuel <> c.fuel)::INT AS d3, (a.wheels <> c.wheels)::INT AS d4, greatest(a.pa * c.pa, (1 - a.pa) * (1 - c.pa)) AS bonus, coalesce((a.cl <> c.cl)::INT, 0) AS apart
  FROM fit a JOIN fit c ON a.kind = c.kind AND a.fam <> c.fam AND abs(a.year - c.year) <= 10, b WHERE a.hp IS NOT NULL AND c.hp IS NOT NULL AND a.mpg IS NOT NULL AND c.mpg IS NOT NULL),
pairs AS (SELECT *, round(((d1 + d2) / 2 + (coalesce(d3, 0) + coalesce(d4, 0)) / ((d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT)) / 2, 9) AS distance FROM raw WHERE d3 IS NOT NULL OR d4 IS NOT NULL),
win AS (SELECT id, CASE WHEN count(DISTINCT pf) FILTER (gap <= 2) >= 5 THEN 2.0 WHEN count(DISTINCT pf) FILTER (gap <= 5) >= 5 THEN 5.0 ELSE 10.0 END AS win FROM pairs GROUP BY 1),
ap(approach, wb, wp) AS (VALUES ('direct', 0.0, 0.0), ('categories', 0.1, 0.0), ('clusters', 0.0, 0.1), ('categories_clusters', 0.1, 0.1)),
sc AS (SELECT id, approach, peer, pf, distance, round(distance - wb * bonus + wp * apart, 9) AS ranking_distance, win FROM pairs JOIN win USING (id), ap WHERE gap <= win),
f AS (SELECT *, row_number() OVER (PARTITION BY id, approach, pf ORDER BY ranking_distance, peer, distance) AS rn FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY id, approach ORDER BY ranking_distance, peer) AS peer_rank FROM f WHERE rn = 1)"""


def _ranked(t: Tables):
    keys = ["make_name", "model_name", "year", "body_type"]
    share = F.round(F.avg(F.when(F.col("transmission") == "A", 1.0).otherwise(0.0)), 6)
    prof = t.used_cars.dropna(subset=keys).groupBy(*keys).agg(
        F.round(F.avg("horsepower"), 6).alias("hp"), F.round(F.avg("city_fuel_economy"), 6).alias("mpg"), F.min("fuel_type").alias("fuel"), F.min("wheel_system").alias("wheels"), share.alias("pa"),
        F.floor(F.avg("highway_fuel_economy") / 8).cast("int").alias("cl"), (F.count("*") >= 2).alias("ok"),
    )
    prof = prof.select(F.concat_ws("|", *keys).alias("id"), F.concat_ws("|", "make_name", "model_name").alias("fam"), F.col("body_type").alias("kind"), "year", "hp", "mpg", "fuel", "wheels", F.create_map(F.lit("auto"), F.col("pa"), F.lit("manual"), F.lit(1.0) - F.col("pa")).alias("gear"), "cl", "ok")
    return P.ranked_peers(prof, "id", "fam", ["kind"], "year", (2, 5, 10), [(["hp", "mpg"], [], 2), ([], ["fuel", "wheels"], 1)], P.APPROACHES[:4], categories=["gear"], clusters=["cl"], eligible="ok")


@q(_RANKED + " SELECT id, approach, peer_rank::BIGINT AS peer_rank, peer, distance, ranking_distance, win::DOUBLE AS \"window\" FROM k WHERE peer_rank <= 5")
def ranked_peers(t: Tables):
    """Five peers of other models per car profile, four ways, in the narrowest year window that gives five."""
    return _ranked(t)[0]


@q(_RANKED + """, s AS (SELECT id, approach, count(*) AS n FROM k WHERE peer_rank <= 5 GROUP BY ALL), o AS (SELECT kind, count(DISTINCT fam) AS fams, min(fam) AS one FROM fit GROUP BY 1)
SELECT prof.id, ap.approach, coalesce(n, 0)::BIGINT AS slate_size, coalesce(win, 10.0)::DOUBLE AS "window",
 CASE WHEN NOT ok THEN 'query_ineligible' WHEN fams IS NULL OR (fams = 1 AND one = fam) THEN 'no_compatible_family' WHEN n IS NULL THEN 'no_shared_evidence' WHEN n < 5 THEN 'shortfall' ELSE 'complete' END AS status
FROM prof CROSS JOIN ap LEFT JOIN s ON s.id = prof.id AND s.approach = ap.approach LEFT JOIN win ON win.id = prof.id LEFT JOIN o ON o.kind = prof.kind""")
def peer_statuses(t: Tables):
    """What became of each profile's search, found or not."""
    return _ranked(t)[1]


@q(_RANKED + """, l AS (SELECT id, approach, list(DISTINCT peer) AS p, avg(distance) AS d FROM k WHERE peer_rank <= 5 GROUP BY ALL), r AS (SELECT id, p AS bp FROM l WHERE approach = 'direct')
SELECT approach, count(*)::BIGINT AS queries, round(avg(d), 6) AS mean_distance, round(avg(len(list_intersect(p, bp)) / len(bp)), 6) AS mean_overlap FROM l JOIN r USING (id) GROUP BY 1""")
def peer_comparison(t: Tables):
    """Each way to rank against the plain one, over the profiles both serve."""
    return P.compare_approaches(_ranked(t)[0], "id", "direct")
