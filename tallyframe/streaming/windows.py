"""Event-time windows for streams; each works on a batch frame as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(df: DataFrame, ts: str, keys: list[str], size: str, late: str | None = None, value: str = "value") -> DataFrame:
    """n and total per window and key. ``late``: watermark; rows later than it are dropped by a stream."""
    if late:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return df.groupBy(F.window(F.col(ts).cast("timestamp") if not late else F.col(ts), size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, keys: list[str], size: str, step: str) -> DataFrame:
    return df.groupBy(F.window(F.col(ts).cast("timestamp"), size, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """n per session: events of a key less than ``gap`` apart."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Streaming state per key (count and sum), one row per key and trigger."""

    def step(k, batches: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def first_seen(df: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: what a resumable loader keeps of re-sent rows."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
