import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyframe.operators import metrics as M
from tallyframe.operators import models as MO


@pytest.fixture(scope="module")
def cars(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        make, year, miles = rng.choice("abc"), rng.randrange(2000, 2020), rng.uniform(0, 200)
        price = 20000 * {"a": 1, "b": 1.5, "c": 0.7}[make] * 0.95 ** (2020 - year) * (1 - miles / 500) * rng.uniform(0.95, 1.05)
        rows.append((i, f"v{i // 2}", make, float(year), None if i % 17 == 0 else miles, price))
    df = spark.createDataFrame(rows, "id int, vin string, make string, year double, miles double, price double")
    return df.withColumn("fold", F.pmod(F.xxhash64("vin"), F.lit(3).cast("bigint")).cast("int")).cache()


def test_regressors_beat_the_median(cars):
    out = {r.kind: r for r in MO.compare_regressors(cars.filter("fold > 0"), cars.filter("fold = 0"), "price", ["year", "miles"], ["make"]).collect()}
    assert set(out) == {MO.BASELINE, *MO.REGRESSORS} and sorted(r.place for r in out.values()) == list(range(1, 10))
    assert all(out[k].beats_median for k in MO.REGRESSORS) and out["boosted"].mae < out["linear"].mae
    none = MO.compare_regressors(cars.limit(0), cars.limit(0), "price", ["year"], ["make"], (MO.BASELINE, "linear")).collect()
    assert all(r.mae is None and r.n == 0 for r in none)


def test_nested_out_of_fold(cars):
    pred, receipts = MO.nested_out_of_fold(cars, "id", "vin", "price", ["year", "miles"], ["make"], "fold", 3)
    got = pred.select("id", "prediction").collect()
    assert sorted(r.id for r in got) == list(range(900)) and all(r.prediction is not None for r in got)
    rec = receipts.orderBy("fold").collect()
    assert [r.fold for r in rec] == [0, 1, 2] and all(r.chosen != MO.BASELINE and r.n_fit + r.n_valid + r.n_held == 900 for r in rec)
    # a leak of the target would be used by a model that saw the held-out rows
    with pytest.raises(ValueError):
        MO.nested_out_of_fold(cars.withColumn("fold", F.col("id") % 3), "id", "vin", "price", ["year"], ["make"], "fold", 3)


def test_growth_stops_at_a_plateau(cars):
    x = VectorAssembler(inputCols=["year", "id"], outputCol="features").transform(cars.select("id", "year", F.log1p("price").alias("y")))
    forests, history = MO.grow_until_plateau(x.filter("id % 3 > 0"), x.filter("id % 3 = 0"), "id", "y", batch=3, gain=0.02, stale=2)
    h = history.collect()
    assert [r.improved for r in h][-2:] == [False, False] and h[0].improved and h[-1].trees == 3 * len(h)
    assert len(forests) == max(i for i, r in enumerate(h) if r.improved) + 1
    mae = MO.forest_prediction(forests, x.filter("id % 3 = 0")).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert abs(mae - h[len(forests) - 1].mae) < 1e-9


def test_parts_reconcile(cars):
    model = MO.fit_log_model(cars, "price", ["year", "miles"], ["make"], "ridge")
    out = MO.explain_log_model(model, cars, ["make"]).collect()
    assert all(r.reconciles and abs(r.base + sum(r.parts.values()) - r.prediction) < 1e-6 for r in out)
    assert set(out[0].parts) == {"year", "miles", "year missing", "miles missing", "make"}
    with pytest.raises(ValueError):
        MO.explain_log_model(MO.fit_log_model(cars, "price", ["year"], ["make"], "tree"), cars, ["make"])


def test_gated_labels(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        labels = [n for n, hit in (("clear", x > 0.3), ("noise", rng.random() < 0.5), ("rare", i == 3)) if hit]
        rows.append((i, f"f{i % 300}", x, z, None if i % 50 == 0 else labels))
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(spark.createDataFrame(rows, "id int, fam string, x double, z double, labels array<string>"))
    decisions, report = MO.gated_labels(df, "id", "fam", "labels", ["clear", "noise", "rare"])
    got = {r.label: r for r in report.collect()}
    assert got["clear"].status == "accepted" and got["clear"].lower_end >= 0.6
    assert got["noise"].status in ("no_threshold", "failed_gate") and got["rare"].status == "insufficient_support"
    d = decisions.collect()
    assert {r.label for r in d} == {"clear"} and sum(rows[r.id][2] > 0.3 for r in d) >= 0.9 * len(d)
    assert MO.gated_labels(df.limit(0), "id", "fam", "labels", ["clear"])[1].first().status == "insufficient_support"


def test_stability(spark):
    rng = random.Random(8)
    rows = [(i, f"f{i % 60}", 10.0 * (i % 3) + rng.gauss(0, 0.5), 10.0 * (i % 3 == 1) + rng.gauss(0, 0.5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, fam string, x double, y double")
    got = {r.k: r for r in MO.stability_screen(df, "id", "fam", ["x", "y"], [], (3, 7), refits=5).collect()}
    assert got[3].status == "accepted" and got[3].median_ari > 0.99 and got[7].median_ari < got[3].median_ari
    assert MO.stability_screen(df.limit(0), "id", "fam", ["x"], [], (2,), 1).count() == 0


def test_vectors_without_the_own_fold(spark):
    rows = [(i, i % 2, f"word{i % 5} shared text {'same copy' if i in (0, 1) else i}") for i in range(20)] + [(20, 0, None)]
    df = spark.createDataFrame(rows, "id int, fold int, t string")
    a = {r.id: r.tfidf for r in MO.isolated_vectors(df, "id", "t", "fold", 2).collect()}
    changed = df.withColumn("t", F.when(F.col("fold") == 1, F.regexp_replace("t", "shared|word[024]", "gone")).otherwise(F.col("t")))
    b = {r.id: r.tfidf for r in MO.isolated_vectors(changed, "id", "t", "fold", 2).collect()}
    assert set(a) == set(range(21))
    assert any(a[i] != b[i] for i in range(0, 20, 2))  # fold 0 is weighted by fold 1
    other = df.withColumn("t", F.when(F.col("id") == 2, F.lit("quite other words")).otherwise(F.col("t")))
    c = {r.id: r.tfidf for r in MO.isolated_vectors(other, "id", "t", "fold", 2).collect()}
    assert all(a[i] == c[i] for i in range(4, 20, 2))  # and not by itself


def test_poisson_counts(spark):
    r = spark.range(200_000).select(MO.bootstrap_weight("id", 1).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(r[0] - 1) < 0.02 and abs(r[1] - 1) < 0.03 and r[2] > 5


def test_spearman_and_conditions(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(20)), rng.gauss(0, 1) if i % 7 else None, 5.0) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got = {(r.a, r.b): r for r in M.spearman(df, ["a", "b", "c"]).collect()}
    pdf = df.toPandas()
    assert abs(got["a", "b"].spearman - pdf[["a", "b"]].dropna().rank().corr().iloc[0, 1]) < 1e-6
    assert got["a", "b"].overlap == pdf.b.notna().sum() and got["a", "c"].spearman is None
    assert M.spearman(df.limit(0), ["a", "b"]).first().spearman is None
    x = df.select("a", (F.col("a") * 2 + F.coalesce("b", F.lit(0.0))).alias("d"))
    idx = M.condition_indices(x, ["a", "d"])
    assert idx[0] == 1.0 and idx[1] > 5


def test_paired_bootstrap(spark):
    rng = random.Random(4)
    rows = [(i, i % 40, "x" if i % 2 else "y", 1.0, 1.0 + (0.5 if i % 2 else 0.0) + rng.gauss(0, 0.3)) for i in range(800)] + [(900, 1, "x", None, 2.0)]
    df = spark.createDataFrame(rows, "id int, fam int, seg string, e1 double, e2 double")
    got = {(r.seg, r.seed): r for r in M.paired_bootstrap(df, "fam", ["seg"], "e1", "e2", draws=300).collect()}
    for seed in "ab":
        assert got["x", seed].decided and abs(got["x", seed].delta - 0.5) < 0.1 and got["x", seed].n == 400
        assert not got["y", seed].decided and got["y", seed].low < got["y", seed].delta < got["y", seed].high
    assert M.paired_bootstrap(df, "fam", [], "e1", "e2", draws=50).count() == 2
