"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q("""
SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS h, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def text_dedup(t: Tables):
    """Groups of documents with the same words."""
    return t.documents.filter("text IS NOT NULL").groupBy(X.word_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@q("""
SELECT row_id, CASE WHEN text IS NULL OR lower(trim(text)) = '' THEN 'empty' WHEN regexp_full_match(lower(trim(text)), 'https?://\\S+') THEN 'url_only' WHEN lower(trim(text)) IN ('lol', 'ok', 'nice', 'first', 'thanks') THEN 'filler' WHEN NOT regexp_matches(lower(trim(text)), '[a-z]') THEN 'no_letters' END AS reason FROM youtube_comments_sentiment
""")
def prefilter_reason(t: Tables):
    return t.youtube_comments_sentiment.select("row_id", X.prefilter_reason(F.col("text")).alias("reason"))


@q("""
WITH s AS (SELECT row_id, CASE WHEN text IS NULL OR text = '' THEN NULL ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) END AS share FROM youtube_comments_sentiment)
SELECT row_id, CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 0.9 THEN 'latin' WHEN share >= 0.5 THEN 'mixed' ELSE 'other' END AS status FROM s
""")
def script_status(t: Tables):
    return t.youtube_comments_sentiment.select("row_id", X.ascii_status(F.col("text")).alias("status"))


@q("""
WITH s AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), m AS (SELECT *, greatest(a, b, c) AS t FROM s),
e AS (SELECT vec_id, exp(a - t) AS a, exp(b - t) AS b, exp(c - t) AS c FROM m), p AS (SELECT vec_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM e),
o AS (SELECT *, greatest(a, b, c) AS t, list_sort([a, b, c], 'DESC') AS l FROM p)
SELECT vec_id, round(a, 9) AS p1, round(b, 9) AS p2, round(c, 9) AS p3, round((-a * ln(a) - b * ln(b) - c * ln(c)) / ln(3), 9) AS entropy, round(l[1] - l[2], 9) AS margin,
 CASE WHEN t >= 0.35 AND l[1] - l[2] >= 0.01 THEN CASE WHEN a = t THEN 'neg' WHEN b = t THEN 'neu' ELSE 'pos' END ELSE 'uncertain' END AS label FROM o
""")
def calibrated_decision(t: Tables):
    """Softmax, entropy, margin and the label they allow."""
    s = [F.col("embedding")[i].cast("double") for i in range(3)]
    probs, entropy, margin = X.calibrated(s)
    rows = t.embeddings.select("vec_id", *[p.alias(f"q{i}") for i, p in enumerate(probs)], entropy.alias("h"), margin.alias("m"))
    ps = [F.col(f"q{i}") for i in range(3)]
    return rows.select("vec_id", *[F.round(p, 9).alias(f"p{i + 1}") for i, p in enumerate(ps)], F.round("h", 9).alias("entropy"), F.round("m", 9).alias("margin"), X.choose_label(["neg", "neu", "pos"], ps, F.col("m"), 0.35, 0.01).alias("label"))


@q("""
WITH l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT label, dim::BIGINT AS dim, round(m / n, 9) AS value FROM m JOIN n USING (label)
""")
def pooled_vectors(t: Tables):
    return X.pooled_vectors(t.embeddings, "label", "embedding")


@q()
def clause_segments(t: Tables):
    return X.clauses(t.youtube_comments_sentiment, "row_id", "text")


@q()
def rule_labels(t: Tables):
    """Topic labels of whole comments by rules; what is denied or only supposed doesn't count."""
    rules = {"brakes": r"\bbrak\w*", "gearbox": r"\b(?:gearbox|transmission)\b", "noise": r"\b(?:loud|noise)\b", "price": r"\b(?:price|money|expensive)\b", "recall": r"\brecall\w*"}
    rows = t.youtube_comments_sentiment.select("row_id", F.array_join(X.rule_labels(F.col("text"), rules, supposed=True, always=("recall",)), ";").alias("labels"))
    return rows.filter("labels <> ''")


@q()
def folded_text_hash(t: Tables):
    return t.documents.select("doc_id", X.folded_hash(F.col("text")).alias("h"))


@q(r"""
WITH p AS (SELECT row_id, regexp_replace(lower(text), '(^|[^\p{L}\p{N}_])\d{3}[-. ]\d{3}[-. ]\d{4}($|[^\p{L}\p{N}_])', '\1 \2', 'g') AS x FROM youtube_comments_sentiment),
w AS (SELECT row_id, x, regexp_extract_all(x, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ws FROM p),
k AS (SELECT row_id, x, array_to_string(list_transform(ws, lambda y: CASE WHEN regexp_full_match(y, '19\d\d|20\d\d|\d\d[ev]\d{6}') OR (regexp_full_match(y, '[a-hj-npr-z0-9]{11,17}') AND regexp_matches(y, '\d')) THEN ' ' ELSE y END), '') AS joined FROM w)
SELECT row_id, CASE WHEN x IS NOT NULL THEN trim(regexp_replace(coalesce(joined, ''), '[\s\x{85}\p{Z}]+', ' ', 'g')) END AS masked FROM k
""")
def masked_text(t: Tables):
    """Texts of all languages prepared for a model: identifiers dropped, lower case."""
    return t.youtube_comments_sentiment.select("row_id", X.mask_for_model(F.col("text")).alias("masked"))


@q("""
SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (text = '')::BIGINT AS empty, count(DISTINCT md5(text))::BIGINT AS texts FROM documents GROUP BY 1
""")
def source_audit(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"), F.count(F.when(F.col("text") == "", 1)).alias("empty"), F.count_distinct(F.md5("text")).alias("texts"))
