"""Queries of the llm problems over whole tables, and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from . import langid, leak, mix, pii, radix, visual

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
_GROUPS = ["make_name", "model_name"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return radix.radix_percentiles(read_table(spark, d, "used_cars"), _GROUPS, ["price", "mileage"], PERCENTILES)


def p1_merged_slices(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of separate slices of listed_date, made apart and merged, beside the exact percentiles of the
    whole: do they hold them, within the stated error?"""
    cars = read_table(spark, d, "used_cars")
    slices = [cars.filter("listed_date IS NULL"), cars.filter("year(listed_date) % 2 = 0"), cars.filter("year(listed_date) % 2 <> 0")]
    whole = radix.merge_histograms([radix.radix_histogram(part, _GROUPS, ["price", "mileage"]) for part in slices], _GROUPS)
    merged = radix.histogram_percentiles(whole, _GROUPS, PERCENTILES).withColumnRenamed("n_values", "merged_n")
    exact = p1_percentiles(spark, d)
    same = [exact[c].eqNullSafe(merged[c]) for c in [*_GROUPS, "metric", "p"]]
    inside = (F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper")) & (F.col("n_values") == F.col("merged_n")) & (F.col("upper") - F.col("lower") <= F.abs("value") * 2.0**-8)
    return exact.join(merged.drop("n_values"), reduce(lambda a, b: a & b, same), "left").select(exact["make_name"], exact["model_name"], exact["metric"], exact["p"], exact["n_values"], exact["value"], F.coalesce(inside, F.lit(False)).alias("within_bound"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(read_table(spark, d, "youtube_comments_sentiment"), read_table(spark, d, "comments"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(_languages(spark, d)).select("comment_id", "segment_no", "lang_code")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


def _name_words(spark: SparkSession, d: str) -> pii.NameWords:
    comments = read_table(spark, d, "youtube_comments_sentiment")
    return pii.name_evidence(comments.select("text").unionByName(pii.json_values(read_table(spark, d, "nhtsa_complaints"), "record_json")), "text", comments.select("author"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    words = _name_words(spark, d)
    a = pii.find_pii(read_table(spark, d, "youtube_comments_sentiment"), "row_id", ["text", "author"], words=words, name_columns=("author",)).withColumn("source_table", F.lit("youtube_comments_sentiment"))
    b = pii.find_pii(read_table(spark, d, "nhtsa_complaints"), "row_id", ["record_json"], ("record_json",), words).withColumn("source_table", F.lit("nhtsa_complaints"))
    return a.unionByName(b).select("source_table", "row_id", "field_name", "pii_type", "nth")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    words = _name_words(spark, d)
    a = pii.redact_pii(read_table(spark, d, "youtube_comments_sentiment"), "row_id", ["text", "author"], words=words, name_columns=("author",))
    b = pii.redact_pii(read_table(spark, d, "nhtsa_complaints"), "row_id", ["record_json"], ("record_json",), words)
    return a.withColumn("source_table", F.lit("youtube_comments_sentiment")).unionByName(b.withColumn("source_table", F.lit("nhtsa_complaints")), allowMissingColumns=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the passages within one edit, those that have 12 words of the item as they are."""
    near = leak.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), max_edits=1)
    return near.filter("min_edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with one word changed, added or missing, and whole items of 6 to 11 words."""
    return leak.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), max_edits=1, shortest=6)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.draw_mixes(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    return mix.draw_mixes(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.lookalike_pairs(read_table(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of those that look like it."""
    return visual.lookalike_classes(read_table(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual.normalise(read_table(spark, d, "documents"), ["doc_id"], "text")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_merged_slices, p2_found, p2_languages, p3_found, p3_redacted, p8_found, p8_near, p9_drawn, p9_report, p10_found, p10_classes, p10_forms)}

_PS = ", ".join(map(str, PERCENTILES))
ORACLE = {
    "p1_percentiles": f"""
WITH l AS (
  SELECT make_name, model_name, 'price' AS metric, price::DOUBLE AS v FROM used_cars
  UNION ALL SELECT make_name, model_name, 'mileage', mileage FROM used_cars),
q AS (SELECT make_name, model_name, metric, count(*)::BIGINT AS n_values, quantile_disc(v, [{_PS}]) AS qs
      FROM l WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY ALL)
SELECT make_name, model_name, metric, ([{_PS}])[i]::DOUBLE AS p, n_values, qs[i] AS value
FROM q, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
""",
}
ORACLE["p1_merged_slices"] = f"SELECT *, true AS within_bound FROM ({ORACLE['p1_percentiles']})"
