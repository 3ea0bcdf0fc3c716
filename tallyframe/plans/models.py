"""Statistical and streaming queries (rows only, except the windows in their batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml, models
from ..streaming import windows as ST
from .registry import Registry, Tables

q = Registry()
QUERIES, ORACLE = q.queries, q.oracle


@q()
def kmeans_profiles(t: Tables):
    prof = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"), F.count("*").cast("double").alias("n"))
    return ml.cluster(prof, ["size", "price"], ["p_type"], 8, weight="n").select("p_brand", "p_type", "cluster")


@q()
def price_regression(t: Tables):
    """Held-out predictions of a model of log price."""
    from ..operators.sampling import group_split

    cars = t.used_cars.filter("price > 500 AND price < 500000 AND vin IS NOT NULL").withColumn("mileage", F.when(~F.isnan("mileage"), F.col("mileage")))
    s = group_split(cars, "vin", {"fit": 0.8, "test": 0.2})
    out = ml.log_price_model(s.filter("split = 'fit'"), s.filter("split = 'test'"), "price", ["mileage", "year", "horsepower"], ["make_name", "body_type", "feed"])
    return out.select("row_id", "price", "prediction")


@q()
def tfidf_vectors(t: Tables):
    v = ml.tfidf(t.documents.select("doc_id", "text"), "text")
    return v.select("doc_id", F.col("tfidf").cast("string").alias("vector"))


@q()
def profile_projection(t: Tables):
    prof = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"), F.max("p_retailprice").alias("top"))
    development = F.pmod(F.xxhash64("p_brand"), F.lit(5).cast("bigint")) > 0
    return ml.project(prof, ["size", "price", "top"], development=development).select("p_brand", "p_type", F.col("projection").cast("string").alias("projection"))


@q("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_windows(t: Tables):
    w = ST.tumbling(t.events, "ts", ["event_type"], "1 day")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@q("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*)::BIGINT AS n FROM k GROUP BY user_id, sid
""")
def session_windows(t: Tables):
    s = ST.sessions(t.events, "ts", ["user_id"], "6 hours")
    return s.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


@q("""
WITH s AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS window_start, event_type, ts FROM events)
SELECT window_start, event_type, count(*)::BIGINT AS n FROM s WHERE ts >= window_start AND ts < window_start + INTERVAL 2 HOUR GROUP BY ALL
""")
def sliding_windows(t: Tables):
    s = ST.sliding(t.events, "ts", ["event_type"], "2 hours", "1 hour")
    return s.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@q()
def document_topics(t: Tables):
    from pyspark.ml.functions import vector_to_array

    d = ml.topics(t.documents.select("doc_id", "text"), "text", 6)
    return d.select("doc_id", F.array_join(F.transform(vector_to_array("topics"), lambda x: F.round(x, 3).cast("string")), ",").alias("topics"))


@q()
def relevance_folds(t: Tables):
    """Out-of-fold scores of a binary text label, folds by video."""
    from ..functions.expr import hash_mod

    lab = t.comments.filter("sentiment IN ('positive', 'negative')").groupBy(F.col("id").alias("comment_id")).agg(F.max((F.col("sentiment") == "positive").cast("double")).alias("label"))
    rows = t.youtube_comments_sentiment.select("row_id", "comment_id", "video_id", "text").join(lab, "comment_id").withColumn("fold", hash_mod("video_id", 3))
    return ml.text_classifier(rows, "text", "label", "fold", 3).select("row_id", "label", "fold", "probability_1")


def _cars(t: Tables):
    from ..functions.expr import hash_mod

    miles = F.when(~F.isnan("mileage") & (F.col("mileage") < 1e6), F.col("mileage"))
    cars = t.used_cars.filter("price > 500 AND price < 500000 AND vin IS NOT NULL").withColumn("mileage", miles)
    return cars.select("row_id", "vin", "price", "mileage", "year", "horsepower", "make_name", "body_type", "feed").withColumn("fold", hash_mod("vin", 3))


_NUMERIC, _CATEGORICAL = ["mileage", "year", "horsepower"], ["make_name", "body_type", "feed"]


@q()
def regressor_comparison(t: Tables):
    """Eight regressors and the median, by their error on held-out vehicles."""
    cars = _cars(t)
    return models.compare_regressors(cars.filter("fold > 0"), cars.filter("fold = 0"), "price", _NUMERIC, _CATEGORICAL)


@q()
def nested_predictions(t: Tables):
    """Every listing's price by a model that was chosen and fitted without its fold."""
    return models.nested_out_of_fold(_cars(t), "row_id", "vin", "price", _NUMERIC, _CATEGORICAL, "fold", 3)[0].select("row_id", "fold", "price", "prediction")


@q()
def nested_receipts(t: Tables):
    return models.nested_out_of_fold(_cars(t), "row_id", "vin", "price", _NUMERIC, _CATEGORICAL, "fold", 3)[1]


@q()
def forest_growth(t: Tables):
    """A forest grown until three batches in a row bring less than 0.1 %."""
    cars = ml.with_flags(_cars(t), _NUMERIC).withColumn("y", F.log1p("price"))
    x = ml.features(_NUMERIC, _CATEGORICAL).fit(cars.filter("fold > 0")).transform(cars).select("row_id", "fold", "y", "features")
    return models.grow_until_plateau(x.filter("fold > 0"), x.filter("fold = 0"), "row_id", "y", batch=20)[1]


@q()
def price_parts(t: Tables):
    """What each field adds to the logarithm of a listing's price; the parts add up to the prediction."""
    cars = _cars(t)
    model = models.fit_log_model(cars.filter("fold > 0"), "price", _NUMERIC, _CATEGORICAL, "ridge")
    return models.explain_log_model(model, cars, _CATEGORICAL).select("row_id", F.explode("parts").alias("field", "part"), "base", "prediction")


@q()
def gated_comment_labels(t: Tables):
    """Report of the sentiment labels that may be emitted for comments, by gates on unseen videos."""
    labels = t.comments.filter("sentiment IS NOT NULL").groupBy(F.col("id").alias("comment_id")).agg(F.collect_set("sentiment").alias("labels"))
    rows = t.youtube_comments_sentiment.select("row_id", "comment_id", "video_id", F.coalesce("text", F.lit("")).alias("text")).join(labels, "comment_id", "left")
    tf = ml.term_counts(rows, "text", 1 << 12, True).withColumnRenamed("__tf", "features")
    return models.gated_labels(tf, "row_id", "video_id", "labels", ["positive", "negative", "neutral", "mixed"])[1]


@q()
def partition_stability(t: Tables):
    """Whether partitions of the car profiles hold up under refits on other draws of the models."""
    prof = t.used_cars.dropna(subset=["make_name", "model_name", "year"]).groupBy("make_name", "model_name", "year").agg(F.avg("horsepower").alias("hp"), F.avg("city_fuel_economy").alias("mpg"), F.avg("highway_fuel_economy").alias("hwy"))
    prof = prof.withColumn("id", F.concat_ws("|", "make_name", "model_name", "year")).withColumn("fam", F.concat_ws("|", "make_name", "model_name"))
    return models.stability_screen(prof, "id", "fam", ["hp", "mpg", "hwy"], [], (3, 5), refits=10)


@q()
def isolated_text_vectors(t: Tables):
    """Word vectors of comments whose rarity comes from other videos and other texts."""
    from ..functions.expr import hash_mod

    v = models.isolated_vectors(t.youtube_comments_sentiment.withColumn("fold", hash_mod("video_id", 3)), "row_id", "text", "fold", 3)
    return v.select("row_id", "fold", F.col("tfidf").cast("string").alias("vector"))
