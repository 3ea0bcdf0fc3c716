import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import radix as R


def nearest(values, p):
    v = sorted(values)
    return v[max(1, len(v) - math.floor(len(v) - p * len(v))) - 1]


def test_bits_keep_order(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 2.2250738585072014e-308, 1 / 3] + [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("b", R.ordered_bits(F.col("x"))).withColumn("y", R.bits_value(F.col("b"))).collect()
    for r in rows:
        want = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.b == (-want if r.x < 0 else want) and r.y == r.x


def data(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.gauss(0, 1e5), 7.0, -3.25]), rng.randint(-50, 50)) for _ in range(4000)]
    rows += [(g, rng.uniform(-1, 1), None) for g in ("a", None) for _ in range(41)]
    rows += [("a", float("nan"), 1), ("a", float("inf"), 1), ("a", None, 2), ("none", None, None), ("one", 3.0, 9)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, v double, k int, bits string, rank int")


PS = [0.0, 0.05, 0.5, 0.9, 1.0]


def test_exact_and_bounds(spark):
    rows, df = data(spark)
    want = {}
    for g in {r[0] for r in rows}:
        for i, m in ((1, "v"), (2, "k")):
            v = [float(r[i]) for r in rows if r[0] == g and r[i] is not None and math.isfinite(r[i])]
            for p in PS if v else ():
                want[g, m, p] = (len(v), nearest(v, p))
    got = {(r.g, r.metric, r.p): (r.n_values, r.value) for r in R.radix_percentiles(df, ["g"], ["v", "k"], PS).collect()}
    assert got == want
    slices = [R.radix_histogram(df.filter("v IS NOT NULL").filter(F.pmod(F.hash("v"), F.lit(3)) == i), ["g"], ["v", "k"]) for i in range(3)] + [R.radix_histogram(df.filter("v IS NULL"), ["g"], ["v", "k"])]
    merged = R.histogram_percentiles(R.merge_histograms(slices, ["g"]), ["g"], PS)
    for r in merged.collect():
        n, v = want[r.g, r.metric, r.p]
        assert r.n_values == n and r.lower <= v <= r.upper
        assert r.upper - r.lower <= 2 ** (12 - 20) * max(abs(r.lower), abs(r.upper)) + 1e-300


def test_edges(spark):
    _, df = data(spark)
    assert R.radix_percentiles(df.limit(0), ["g"], ["v"], PS).count() == 0
    with pytest.raises(ValueError):
        R.radix_histogram(df.withColumnRenamed("g", "digit"), ["digit"], ["v"])
