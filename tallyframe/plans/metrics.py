"""Model-error, agreement and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import with_row
from ..operators import metrics as M
from ..operators import frames as FR
from ..operators import reports as RP
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle

_PRED = """p AS (SELECT o.*, s.predicted FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS predicted FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"""
_AGG = """count(*)::BIGINT AS n, round(avg(abs(predicted - o_totalprice)), 3) AS mae, round(sqrt(avg((predicted - o_totalprice) * (predicted - o_totalprice))), 3) AS rmse,
 round(CASE WHEN var_pop(o_totalprice) > 0 THEN 1 - sum((predicted - o_totalprice) * (predicted - o_totalprice)) / (var_pop(o_totalprice) * count(*)) END, 3) AS r2,
 round(CASE WHEN sum(o_totalprice) > 0 THEN 100.0 * sum(abs(predicted - o_totalprice)) / sum(o_totalprice) END, 3) AS wape_pct, round(avg(predicted - o_totalprice), 3) AS bias, round(quantile_cont(abs(predicted - o_totalprice), 0.95), 3) AS p95_error"""


def _predictions(t: Tables):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("predicted"))
    return t.orders.join(s, "o_orderkey")


@q(f"WITH {_PRED} SELECT {_AGG} FROM p")
def regression_metrics(t: Tables):
    return _predictions(t).agg(*M.regression("o_totalprice", "predicted", 3))


@q(f"""WITH {_PRED} SELECT 'o_orderstatus' AS dimension, o_orderstatus AS segment, {_AGG} FROM p GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, {_AGG} FROM p GROUP BY 2
UNION ALL SELECT 'o_year', year(o_orderdate)::VARCHAR, {_AGG} FROM p GROUP BY 2""")
def segment_metrics(t: Tables):
    rows = _predictions(t).withColumn("o_year", F.year("o_orderdate"))
    return M.segmented(rows, ["o_orderstatus", "o_orderpriority", "o_year"], M.regression("o_totalprice", "predicted", 3))


@q(f"""WITH {_PRED} SELECT year(o_orderdate)::INT AS o_year, o_orderpriority, grouping(year(o_orderdate), o_orderpriority)::BIGINT AS level, {_AGG} FROM p
GROUP BY GROUPING SETS ((year(o_orderdate)), (o_orderpriority), (year(o_orderdate), o_orderpriority))""")
def year_make_metrics(t: Tables):
    return M.grouped_sets(_predictions(t).withColumn("o_year", F.year("o_orderdate")), "o_year", "o_orderpriority", M.regression("o_totalprice", "predicted", 3))


@q(f"""
WITH {_PRED}, e AS (SELECT o_orderpriority, (predicted - o_totalprice) * (predicted - o_totalprice) AS sq FROM p), c AS (SELECT quantile_cont(sq, 0.99) AS cut, sum(sq) AS total FROM e)
SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(sq) / max(total), 6) AS share, round(sum(sq) FILTER (sq >= cut) / max(total), 6) AS top_share FROM e, c GROUP BY 1
""")
def error_concentration(t: Tables):
    """Share of squared error per segment, and of it in the largest hundredth of rows."""
    return RP.error_concentration(_predictions(t).withColumn("e", F.col("predicted") - F.col("o_totalprice")), "o_orderpriority", "e")


@q(f"""
WITH {_PRED}, x AS (SELECT o_orderpriority, abs(predicted - o_totalprice) AS e1, abs(round(predicted, -3) - o_totalprice) AS e2 FROM p)
SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(e2 - e1), 4) AS mean_delta, round(avg(CASE WHEN e1 < e2 THEN 1.0 ELSE 0.0 END), 6) AS win_share FROM x GROUP BY 1
""")
def paired_errors(t: Tables):
    """Two predictions of the same rows compared."""
    rows = _predictions(t)
    error = lambda p: rows.select("o_orderkey", "o_orderpriority", F.abs(p - F.col("o_totalprice")).alias("e"))
    x = FR.paired(error(F.col("predicted")), error(F.round("predicted", -3)), ["o_orderkey"], ["o_orderpriority"], "e")
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(F.col("e_2") - F.col("e_1")), 4).alias("mean_delta"), F.round(F.avg(F.when(F.col("e_1") < F.col("e_2"), 1.0).otherwise(0.0)), 6).alias("win_share"))


@q("""
WITH x AS (SELECT (l_returnflag = 'R')::INT AS truth, (l_discount >= 0.05)::INT AS guess, l_linenumber AS g FROM lineitem),
c AS (SELECT g, count(*) FILTER (truth = 1 AND guess = 1)::BIGINT AS tp, count(*) FILTER (truth <> 1 AND guess = 1)::BIGINT AS fp, count(*) FILTER (truth = 1 AND guess <> 1)::BIGINT AS fn, count(*) FILTER (truth <> 1 AND guess <> 1)::BIGINT AS tn FROM x GROUP BY 1),
r AS (SELECT *, tp / nullif(tp + fn, 0) AS p, (tp + fn)::DOUBLE AS m FROM c)
SELECT g, tp, fp, fn, tn, round(p, 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS "precision",
 round(CASE WHEN m > 0 THEN greatest(0, (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) ELSE 0 END, 9) AS low,
 round(CASE WHEN m > 0 THEN least(1, (p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) ELSE 1 END, 9) AS high FROM r, (SELECT 1.959963984540054::DOUBLE AS z)
""")
def confusion_wilson(t: Tables):
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("truth"), (F.col("l_discount") >= 0.05).cast("int").alias("guess"), F.col("l_linenumber").alias("g"))
    c = x.groupBy("g").agg(*M.confusion("truth", "guess"))
    lo, hi = M.wilson(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    return c.withColumns({"low": F.round(lo, 9), "high": F.round(hi, 9)})


@q("""
WITH t AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM t),
s AS (SELECT sum(n)::DOUBLE AS n, sum(n * n / (ra * rb)) AS q, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k FROM m)
SELECT n::BIGINT AS n, round((q - 1) * n, 4) AS chi2, round(sqrt(greatest(0, q - 1 - (r - 1) * (k - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)), 9) AS cramers_v FROM s
""")
def contingency_cramers_v(t: Tables):
    return M.cramers_v(t.lineitem, "l_returnflag", "l_linenumber")


@q("""
WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1), s AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS mu, sum(n * m * m) AS q, sum(n * v) AS w FROM g)
SELECT n::BIGINT AS n, round(sqrt((q - n * mu * mu) / (q - n * mu * mu + w)), 6) AS eta FROM s
""")
def eta_ratio(t: Tables):
    return M.eta_ratio(t.part, "p_brand", "p_retailprice")


@q("""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*)::BIGINT AS overlap, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem
""")
def pairwise_corr(t: Tables):
    return M.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@q("""
WITH t AS (SELECT label, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL),
i AS (SELECT sum(m * (m - 1) / 2.0) AS i FROM (SELECT sum(n) AS m FROM t GROUP BY label)), j AS (SELECT sum(m * (m - 1) / 2.0) AS j FROM (SELECT sum(n) AS m FROM t GROUP BY b)), c AS (SELECT sum(n * (n - 1) / 2.0) AS ij, sum(n) AS n FROM t)
SELECT n::BIGINT AS n, round((ij - i * j / (n * (n - 1) / 2.0)) / ((i + j) / 2.0 - i * j / (n * (n - 1) / 2.0)), 9) AS ari FROM c, i, j
""")
def adjusted_rand(t: Tables):
    return M.adjusted_rand(t.embeddings.withColumn("b", F.col("vec_id") % 7), "label", "b")


@q("""
WITH g AS (SELECT p_brand, count(*)::BIGINT AS n, round((count(*) FILTER (p_size > 25))::DOUBLE / count(*), 9) AS p FROM part GROUP BY 1),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_brand) AS raw FROM g)
SELECT p_brand, n, p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, p_brand DESC ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM r
""")
def adjusted_p(t: Tables):
    """Step-up adjustment over a table of test values."""
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_size") > 25).cast("double")), 9).alias("p"))
    return M.adjust_p(g, "p", "adjusted", ("p_brand",)).select("p_brand", "n", "p", F.round("adjusted", 9).alias("adjusted"))


@q()
def bootstrap_bias(t: Tables):
    """Interval of the mean error by a block bootstrap over customers (hashed draws)."""
    e = _predictions(t).withColumn("err", F.col("predicted") - F.col("o_totalprice"))
    draws = M.bootstrap_means(e, "o_custkey", "err", 200)
    return draws.agg(F.count("*").alias("draws"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


@q("""
WITH x AS (SELECT event_type, user_id % 4 AS approach, avg(value) AS score FROM events GROUP BY ALL), w AS (SELECT event_type, max(score) FILTER (approach = 0) AS a0, max(score) FILTER (approach = 1) AS a1 FROM x GROUP BY 1)
SELECT event_type, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a1 - a0, 6) AS delta, a1 - a0 > 0 AS adopt FROM w
""")
def review_gate(t: Tables):
    """Scores per approach side by side with the gate on their difference."""
    x = t.events.groupBy("event_type", (F.col("user_id") % 4).alias("approach")).agg(F.avg("value").alias("score"))
    w = x.groupBy("event_type").agg(F.max(F.when(F.col("approach") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("approach") == 1, F.col("score"))).alias("s1"))
    return w.select("event_type", F.round("s0", 6).alias("a0"), F.round("s1", 6).alias("a1"), F.round(F.col("s1") - F.col("s0"), 6).alias("delta"), (F.col("s1") - F.col("s0") > 0).alias("adopt"))


@q("""
WITH p AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*)::BIGINT AS overlap, round(corr(ra, rb), 6) AS spearman FROM r UNION ALL SELECT 'l_quantity', 'l_discount', count(*)::BIGINT, round(corr(ra, rc), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*)::BIGINT, round(corr(rb, rc), 6) FROM r
""")
def spearman_ranks(t: Tables):
    """Rank correlation of every pair of columns, ties at their mean rank."""
    return M.spearman(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@q()
def paired_intervals(t: Tables):
    """Whether rounding predictions to thousands changes their error, per priority, resampling customers."""
    rows = _predictions(t)
    e1, e2 = F.abs(F.col("predicted") - F.col("o_totalprice")), F.abs(F.round("predicted", -3) - F.col("o_totalprice"))
    return M.paired_bootstrap(rows.select("o_custkey", "o_orderpriority", e1.alias("e1"), e2.alias("e2")), "o_custkey", ["o_orderpriority"], "e1", "e2", draws=200)


@q("""
WITH c AS (SELECT fuel_type, wheel_system, count(*) AS n FROM used_cars WHERE fuel_type IS NOT NULL AND wheel_system IS NOT NULL GROUP BY ALL), g AS (SELECT fuel_type, max(n) AS top, sum(n) AS n FROM c GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sum(top)::BIGINT AS correct, round(sum(top) / sum(n), 9) AS accuracy FROM g
""")
def modal_mapping(t: Tables):
    """How often the wheel system follows from the fuel type alone."""
    return M.modal_accuracy(t.used_cars, "fuel_type", "wheel_system")
