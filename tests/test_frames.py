import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import frames as FR
from tallyframe.operators import joins as J
from tallyframe.operators import reports as RP


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, *FR.first_source({"a": lit(None).cast("string"), "b": lit("x")}), *FR.first_source({"a": lit(None).cast("string")})) == ("x", "b", None, "missing")
    assert one(spark, *[FR.typed_amount(lit(x)) for x in ("18k", "$18,000", " 7500 ", "20.5K", "cheap", None)]) == (18000, 18000, 7500, 20500, None, None)
    assert one(spark, FR.torque_nm(lit("200 lb-ft @ 2000 RPM")), FR.torque_nm(lit("50 Nm")), FR.torque_nm(lit("none")), FR.number_before(lit("9 x 2000 RPM"), "RPM")) == (271.163590, 50.0, None, 2000.0)
    assert one(spark, *FR.in_range(lit(6), 1, 5), *FR.in_range(lit(None).cast("int"), 1, 5), *FR.in_range(lit(3), 1, 5)) == (None, True, None, True, 3, False)
    assert one(spark, FR.has_label(lit("a; b;c"), "b"), FR.has_label(lit("ab"), "b"), FR.has_label(lit(None).cast("string"), "b")) == (True, False, False)
    assert one(spark, FR.recode(lit("x"), {"x": "y"}, "z"), FR.recode(lit(None).cast("string"), {"x": "y"}, "z"), FR.recode(lit("x"), {}), FR.catalog_key(lit("CX-5 GT"))) == ("y", "z", None, "cx5gt")
    assert one(spark, FR.dictionary_terms(lit("Rear seat and seat"), ["seat", "rear seat"]), FR.dictionary_terms(lit("the rear seats, rear seat"), ["seat", "rear seat"]), FR.dictionary_terms(lit(None).cast("string"), ["seat"])) == (["seat", "rear seat"], ["rear seat"], None)
    assert one(spark, FR.option_flag(lit("['Alloy Wheels', 'Sun']"), "Sun"), FR.option_flag(lit("['Sunroof']"), "Sun"), FR.option_flag(lit("Sun"), "Sun")) == (1, 0, None)
    assert str(one(spark, FR.dates_in_formats(lit("31.12.2020"), ("MM/dd/yyyy", "dd.MM.yyyy")), FR.dates_in_formats(lit("soon"), ("yyyy-MM-dd",)))) == "(datetime.date(2020, 12, 31), None)"
    assert one(spark, FR.array_mean(F.array(lit(1), lit(2))), FR.array_mean(F.array().cast("array<int>")), FR.date_after(lit("2020-01-31").cast("date"), lit(-1))) == (1.5, None, None)


def test_blocks_and_pairs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, 7), (3, 8)], "k int, b int")
    assert {(r.k, r.a, r.b) for r in FR.outer_features([a, b], ["k"]).collect()} == {(1, "x", None), (2, "y", 7), (3, None, 8), (None, "n", None)}
    with pytest.raises(ValueError):
        FR.outer_features([a.unionByName(a), b], ["k"])
    p = FR.paired(b, b.withColumn("b", F.col("b") + 1), ["k"], [], "b")
    assert {(r.k, r.b_1, r.b_2) for r in p.collect()} == {(2, 7, 8), (3, 8, 9)}
    with pytest.raises(ValueError):
        FR.paired(b, b.limit(1), ["k"], [], "b")
    with pytest.raises(ValueError):
        FR.paired(b.withColumn("s", F.lit("1")), b.withColumn("s", F.lit("2")), ["k"], ["s"], "b")
    m = FR.merge_annotations(spark.createDataFrame([(1, "a"), (2, "a"), (4, None)], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "k int, v string"), "k", "v")
    assert {(r.k, r.v, r.conflict) for r in m.collect()} == {(1, "a", False), (2, None, True), (3, "c", False), (4, "d", False)}
    c = FR.changed_attributes(spark.createDataFrame([(1, "x", None), (2, "y", "z"), (9, "q", "q")], "k int, a string, b string"), spark.createDataFrame([(1, "x", None), (2, "y", "w")], "k int, a string, b string"), "k", ["a", "b"])
    assert {(r.k, r.changed) for r in c.collect()} == {(2, "b"), (9, "gone")}


def test_events_versions_and_protection(spark):
    rows = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-01")], "k int, d string").withColumn("d", F.to_date("d"))
    ev = spark.createDataFrame([(1, "a", "2020-02-01"), (1, "a", "2020-03-01"), (None, "b", "2020-03-01")], "k int, e string, day string").withColumn("day", F.to_date("day"))
    got = {r.k: (r.n_events, r.late_event) for r in FR.latest_event(rows, ev, ["k"], "day", "e", F.col("d")).collect()}
    assert got == {1: (1, True), 2: (0, False)}
    v = spark.createDataFrame([("r", "A", "1"), ("r", "A", "2"), ("s", "A", "1"), ("s", "B", "1"), ("t", None, "1")], "key string, make string, payload string")
    assert {(r.key, r.state) for r in FR.version_states(v, "key", ["make"], "payload").collect()} == {("r", "conflict"), ("s", "several_families"), ("t", "kept")}
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    assert [r.n for r in FR.unprotected(df, {"id": spark.createDataFrame([("a",), (None,)], "x string")}).collect()] == [2]
    e = FR.eligibility(df, {"named": F.col("id").isNotNull(), "small": F.col("n") < 2}).collect()
    assert {(r.n, r.failed, r.eligible) for r in e} == {(1, "", True), (2, "small", False), (3, "named;small", False)}
    s = FR.supported_rows(spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), (None, 1)], "g string, n int"), ["g"], 2)
    assert {(r.g, r.eligible) for r in s.collect()} == {("x", True), ("y", False), (None, None)}


def test_reasons_and_prefixes(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("a", 40.0), ("b", None), (None, 5.0)], "g string, v double")
    rules = {"high": lambda m: F.col("v") > 2 * m["m"]}
    for error in (0.0, 0.001):
        got = FR.cohort_reasons(df, ["g"], {"m": F.col("v")}, F.col("v") > 0, rules, error)
        assert sorted((r.g or "", r.reasons) for r in got.collect()) == [("", ""), ("a", ""), ("a", ""), ("a", "high"), ("b", "")]
    left = spark.createDataFrame([(1, "M", "CX 5 GT"), (2, "M", "CX 5"), (3, "M", "CXX"), (4, None, "CX"), (5, "M", None), (6, "M", "CX  5")], "id int, mk string, txt string")
    pre = spark.createDataFrame([("M", "CX"), ("M", "CX 5"), ("M", "CX 5"), ("N", "CXX"), ("M", None)], "mk string, prefix string")
    got = {r.id: r.matched_prefix for r in J.longest_prefix_join(left, pre, ["mk"], "txt", "prefix", ["id"]).collect()}
    assert got == {1: "CX 5", 2: "CX 5", 3: None, 4: None, 5: None, 6: "CX"}


def test_samples_and_models(spark):
    rows = [(i, "abc"[i % 3], f"v{i % 7}", f"text {i % 40}") for i in range(210)]
    df = spark.createDataFrame(rows, "id int, s string, video string, text string")
    out = FR.strata_sample(df, "id", "s", {"a": 0.3, "b": 0.2, "c": 0.5}, 20, "video", 4, "text").collect()
    assert len({r.text for r in out}) == len(out) <= 20 and max(pd.Series([r.video for r in out]).value_counts()) <= 4
    assert sum(r.s == "a" for r in out) <= 6 and sum(r.s == "b" for r in out) <= 4
    scored = FR.score_batches(df, ["id"], lambda: lambda p: [p["id"] * 2.0], {"score": T.DoubleType()})
    assert all(r.score == 2.0 * r.id for r in scored.collect())
    assert sum(r.weight for r in FR.group_weights(df, "s").collect()) == pytest.approx(3)


def test_reports(spark):
    ev = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, False), ("b", 1, None)], "g string, u int, f boolean")
    got = {r.g: (r.f_share, r.n, r.supported) for r in RP.united_shares(ev, ["u"], ["g"], {"f": F.col("f")}, least_units=2).collect()}
    assert got == {"a": (0.5, 2, True), "b": (None, 1, False)}
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [tuple(r) for r in RP.equal_bins(flat, "v").collect()] == [(1, 2)]
    cov = {(r.g, r.dimension): r.share for r in RP.coverage(ev, ["g"], ["u", "f"]).collect()}
    assert cov["b", "f"] == 0.0 and cov["a", "u"] == 1.0
    cards = spark.createDataFrame([("c1", "x", 1, True), ("c1", "x", 2, False), ("c1", "y", 1, True), ("c2", "x", 1, True)], "card string, ap string, item int, ok boolean")
    assert [tuple(r) for r in RP.review_scores(cards, "card", "ap", "item", F.col("ok"), "x", "y").collect()] == [("c1", 0, 1, 1)]
    r = RP.reasons(ev.select("g", "u"), ["p", "q"], [("first", (F.col("dimension") == "p") & (F.col("u") == 1)), ("second", F.col("u") == 1)])
    assert sorted((x.dimension, x.u, x.reason) for x in r.filter("g = 'a'").distinct().collect()) == [("p", 1, "first"), ("p", 2, "covered"), ("q", 1, "second"), ("q", 2, "covered")]
    err = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 0.0, 10.0), (None, 0.0, None)], "f string, e double, v double")
    assert [(x.f, x.share, x.running_share) for x in RP.error_families(err, "f", "e", 2).collect()][0] == ("a", 1.0, 1.0)
    assert {(x.bin, x.n, x.share) for x in RP.error_bins(err, "v", "e", 20).collect()} == {(0.0, 2, 0.1), (20.0, 1, 0.9)}
    fields = spark.createDataFrame([(i, i * 2.0, float(i % 3), 1.0, None) for i in range(30)], "a int, b double, c double, d double, e double")
    assert RP.independent_fields(fields, ["a", "b", "c", "d", "e"]) == ["a", "c"]
    assert RP.best_overlap(err.limit(0), "f", "e").count() == 0
