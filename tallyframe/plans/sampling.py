"""Sampling, split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash_mod
from ..operators import sampling as S
from ..operators import frames as FR
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle

_RN = "row_number() OVER (PARTITION BY {p} ORDER BY sha256('{s}|' || {k}::VARCHAR), {k})"


@q(f"""
WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, {_RN.format(p="c_nationkey, c_mktsegment", s="42", k="c_custkey")} AS r, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)
SELECT c_custkey, CASE WHEN n < 10 THEN 'excluded' WHEN r <= n // 5 THEN 'test' WHEN r <= 2 * (n // 5) THEN 'validation' ELSE 'fit' END AS split FROM r
""")
def stratified_split(t: Tables):
    return S.stratified_split(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey", 10).select("c_custkey", "split")


@q(f"SELECT c_custkey, (({_RN.format(p='c_nationkey', s='42', k='c_custkey')} - 1) % 5)::BIGINT AS fold FROM customer")
def kfold_assign(t: Tables):
    return S.folds(t.customer, ["c_nationkey"], "c_custkey", 5).select("c_custkey", "fold")


@q(f"""SELECT c_custkey, {_RN.format(p='c_nationkey', s='7', k='c_custkey')} <= greatest(1, count(*) OVER (PARTITION BY c_nationkey) // 5) AS inner_validation FROM customer""")
def inner_split(t: Tables):
    return S.inner_split(t.customer, ["c_nationkey"], "c_custkey").select("c_custkey", "inner_validation")


@q(f"""
WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT *, least(n, 3) AS base, n - least(n, 3) AS rest FROM g),
p AS (SELECT *, greatest(0, 200 - sum(base) OVER ()) AS pool, sum(rest) OVER () AS allrest FROM b),
i AS (SELECT *, CASE WHEN allrest > 0 THEN least(rest::DOUBLE, pool::DOUBLE * rest / allrest) ELSE 0 END AS ideal FROM p),
w AS (SELECT *, floor(ideal) AS whole, pool - sum(floor(ideal)) OVER () AS more FROM i),
f AS (SELECT c_nationkey, (base + whole + CASE WHEN row_number() OVER (ORDER BY ideal - whole DESC, c_nationkey) <= more AND whole < rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM w),
r AS (SELECT c_custkey, c_nationkey, {_RN.format(p="c_nationkey", s="42", k="c_custkey")} AS r FROM customer)
SELECT c_custkey, c_nationkey FROM r JOIN f USING (c_nationkey) WHERE r <= quota
""")
def quota_sample(t: Tables):
    """200 rows: three of each group, the rest in proportion by largest remainder."""
    return S.quota_sample(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 200, 3).select("c_custkey", "c_nationkey")


@q(f"""
WITH r AS (SELECT c_custkey, {_RN.format(p="c_nationkey, c_mktsegment", s="42", k="c_custkey")} AS r, sha256('42|' || c_custkey::VARCHAR) AS h FROM customer)
SELECT c_custkey FROM r ORDER BY r, h, c_custkey LIMIT 300
""")
def round_robin_sample(t: Tables):
    return S.round_robin_sample(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "c_custkey", 300).select("c_custkey")


@q("SELECT o_orderkey, (('0x' || substr(sha256('42|' || o_orderkey::VARCHAR), 1, 15))::BIGINT % 5)::BIGINT AS bucket FROM orders")
def hash_folds(t: Tables):
    return t.orders.select("o_orderkey", hash_mod("o_orderkey", 5).alias("bucket"))


@q("""
WITH u AS (SELECT o_orderkey, ('0x' || substr(sha256('42|' || o_custkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.6 THEN 'fit' WHEN u < 0.6 + 0.2 THEN 'validation' ELSE 'test' END AS split FROM u
""")
def group_holdout(t: Tables):
    """Whole customers to splits by hash; no shuffle."""
    return S.group_split(t.orders, "o_custkey", {"fit": 0.6, "validation": 0.2, "test": 0.2}).select("o_orderkey", "split")


@q("""
WITH f AS (SELECT md5(text) AS h, arg_min(source, doc_id) AS first_owner FROM documents GROUP BY 1)
SELECT doc_id, source, first_owner FROM documents JOIN f ON f.h = md5(text)
""")
def first_owner(t: Tables):
    """The source that owns a repeated text: that of its first document."""
    docs = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    return S.first_owner(docs, "h", "source", ["doc_id"]).select("doc_id", "source", "first_owner")


@q("""
SELECT c_custkey, round(1.0 / count(*) OVER (PARTITION BY c_nationkey), 12) AS weight FROM customer
""")
def family_weights(t: Tables):
    return FR.group_weights(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "weight")


@q(f"""
WITH r AS (SELECT row_id, video_id, {_RN.format(p="video_id", s="42", k="row_id")} AS r FROM youtube_comments_sentiment) SELECT row_id, video_id FROM r WHERE r <= 5
""")
def balanced_comments(t: Tables):
    """Five comments of each video by hash (the cap is the rule of this sample)."""
    from pyspark.sql import Window as W

    from ..functions.expr import sha_hex

    w = W.partitionBy("video_id").orderBy(sha_hex("row_id", salt="42"), "row_id")
    return t.youtube_comments_sentiment.select("row_id", "video_id").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("row_id", "video_id")
