"""Opinion queries: dedup, windows, balanced aggregation, wide features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import opinion as O
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle

_POL = "CASE WHEN value IS NULL THEN 'no_opinion' WHEN value < 3 THEN 'unresolved' WHEN value > 60 THEN 'positive' WHEN value < 20 THEN 'negative' WHEN value > 50 THEN 'mixed' ELSE 'neutral' END"


def _opinions(t: Tables):
    v = F.col("value")
    p = F.when(v.isNull(), "no_opinion").when(v < 3, "unresolved").when(v > 60, "positive").when(v < 20, "negative").when(v > 50, "mixed").otherwise("neutral")
    return t.events.select("event_id", "user_id", "event_type", "ts", "props", p.alias("polarity"))


def _balanced_sql(least: int, units: int, source: str, keys: str) -> str:
    return f"""
WITH o AS ({source}), per AS (SELECT user_id, {keys}, count(*) AS c, count(*) FILTER (polarity IN ('positive', 'negative', 'neutral', 'mixed')) AS n, count(*) FILTER (polarity = 'positive') AS p, count(*) FILTER (polarity = 'negative') AS m, count(*) FILTER (polarity = 'unresolved') AS u FROM o GROUP BY ALL),
g AS (SELECT {keys}, sum(n)::BIGINT AS opinions, (count(*) FILTER (n > 0))::BIGINT AS units, count(*)::BIGINT AS observed_units, sum(p)::BIGINT AS positive, sum(m)::BIGINT AS negative, sum(u)::BIGINT AS unresolved, round(sum(u) / sum(c), 9) AS unresolved_share,
 avg((p - m) / n) FILTER (n > 0) AS b, stddev_pop((p - m) / n) FILTER (n > 0) AS s, sum(p - m) / nullif(sum(n), 0) AS w FROM per GROUP BY ALL)
SELECT {keys}, opinions, units, observed_units, positive, negative, unresolved, unresolved_share, CASE WHEN opinions >= {least} AND units >= {units} THEN round(b, 9) END AS balanced_net,
 CASE WHEN opinions >= {least} AND units >= {units} THEN round(s, 9) END AS unit_std, CASE WHEN opinions >= {least} AND units >= {units} THEN round(w, 9) END AS weighted_net,
 NOT (opinions >= {least} AND units >= {units}) AS support_suppressed FROM g"""


@q(_balanced_sql(20, 5, f"SELECT *, {_POL} AS polarity FROM events", "event_type"))
def opinion_by_type(t: Tables):
    """Net opinion per aspect with every user weighted alike."""
    return O.balanced(_opinions(t), "user_id", ["event_type"], "polarity")


@q(_balanced_sql(20, 5, f"SELECT *, {_POL} AS polarity FROM (SELECT arg_min(event_id, (ts, event_id)) AS event_id, user_id, event_type, props, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type, props)", "event_type"))
def opinion_deduplicated(t: Tables):
    """The same after keeping the first of repeated texts per user and aspect."""
    first = O.first_of_duplicates(_opinions(t), ["user_id", "event_type", "props"], ["ts", "event_id"])
    return O.balanced(first, "user_id", ["event_type"], "polarity")


@q("""
WITH ends AS (SELECT (m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS window_end FROM (SELECT unnest(generate_series(date_trunc('month', min(published)), date_trunc('month', max(published)), INTERVAL 1 MONTH)) AS m FROM comments))
SELECT window_end, sentiment, count(*)::BIGINT AS opinions, count(DISTINCT video)::BIGINT AS videos FROM comments JOIN ends ON published::DATE <= window_end AND published::DATE > window_end - INTERVAL 12 MONTH GROUP BY ALL
""")
def opinion_windows(t: Tables):
    """Trailing windows of twelve calendar months that end at each month end."""
    ends = O.window_ends(t.comments, "published")
    rows = O.in_windows(t.comments.select("published", "sentiment", "video").filter("published IS NOT NULL"), ends, "published", 12)
    return rows.groupBy("window_end", "sentiment").agg(F.count("*").alias("opinions"), F.count_distinct("video").alias("videos"))


@q(f"""
WITH p AS (SELECT user_id, event_type, round(avg(value), 6) AS net FROM events GROUP BY ALL)
SELECT user_id, max(net) FILTER (event_type = 'click') AS click_net, (max(net) FILTER (event_type = 'click') IS NULL)::INT AS click_missing,
 max(net) FILTER (event_type = 'view') AS view_net, (max(net) FILTER (event_type = 'view') IS NULL)::INT AS view_missing FROM p GROUP BY 1
""")
def opinion_wide(t: Tables):
    per = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("net"))
    return O.widen(per, ["user_id"], "event_type", ["click", "view"], "net")


@q(f"""
WITH o AS (SELECT user_id, event_type, {_POL} AS polarity FROM events)
SELECT user_id, event_type, CASE WHEN count(polarity) = 0 OR bool_or(polarity = 'unresolved') THEN 'unresolved' WHEN bool_or(polarity = 'positive') AND bool_or(polarity = 'negative') THEN 'mixed'
 WHEN bool_or(polarity = 'positive') THEN 'positive' WHEN bool_or(polarity = 'negative') THEN 'negative' ELSE 'neutral' END AS polarity FROM o GROUP BY ALL
""")
def collapsed_polarity(t: Tables):
    return _opinions(t).groupBy("user_id", "event_type").agg(O.collapse("polarity").alias("polarity"))


@q("""
SELECT comment_id, row_id, row_number() OVER (PARTITION BY video_id, md5(text) ORDER BY row_id)::BIGINT AS dup_rank FROM youtube_comments_sentiment
""")
def duplicate_rank(t: Tables):
    """Rank of each comment among equal texts of its video."""
    rows = t.youtube_comments_sentiment.select("comment_id", "row_id", "video_id", F.md5("text").alias("h"))
    return O.duplicate_rank(rows, ["video_id", "h"], "row_id").select("comment_id", "row_id", "dup_rank")


@q("""
SELECT video_id, count(*)::BIGINT AS n_comments, count(DISTINCT comment_id)::BIGINT AS n_ids, min(published_at) AS first_at, count(*) FILTER (trim(coalesce(text, '')) = '')::BIGINT AS blank, count(DISTINCT video_title)::BIGINT AS titles
FROM youtube_comments_sentiment GROUP BY 1
""")
def video_summary(t: Tables):
    return t.youtube_comments_sentiment.groupBy("video_id").agg(
        F.count("*").alias("n_comments"), F.count_distinct("comment_id").alias("n_ids"), F.min("published_at").alias("first_at"),
        F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1)).alias("blank"), F.count_distinct("video_title").alias("titles"),
    )


@q("""
SELECT c.video_id, count(*)::BIGINT AS unscored FROM youtube_comments_sentiment c WHERE NOT EXISTS (SELECT 1 FROM comments s WHERE s.id = c.comment_id) GROUP BY 1
""")
def unscored_queue(t: Tables):
    """Comments without a scored record, by video (the fetch queue)."""
    return t.youtube_comments_sentiment.join(t.comments.select(F.col("id").alias("comment_id")), "comment_id", "left_anti").groupBy("video_id").agg(F.count("*").alias("unscored"))


@q("""
SELECT scope, sentiment, count(*)::BIGINT AS n, sum(eligible)::BIGINT AS eligible, count(DISTINCT video)::BIGINT AS videos FROM comments WHERE published <= TIMESTAMP '2025-12-31' AND updated <= TIMESTAMP '2026-06-30' GROUP BY ALL
""")
def dual_cutoff(t: Tables):
    """Scored comments published and updated by two cutoffs."""
    rows = t.comments.filter("published <= timestamp_ntz'2025-12-31' AND updated <= timestamp_ntz'2026-06-30'")
    return rows.groupBy("scope", "sentiment").agg(F.count("*").alias("n"), F.sum("eligible").alias("eligible"), F.count_distinct("video").alias("videos"))
