import datetime as dt
import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.functions import expr as X
from tallyframe.operators import catalog as C
from tallyframe.operators import checks as CH
from tallyframe.operators import clean as CL
from tallyframe.operators import evidence as E
from tallyframe.operators import joins as J
from tallyframe.operators import manifest as MF
from tallyframe.operators import metrics as M
from tallyframe.operators import opinion as O
from tallyframe.operators import peers as P
from tallyframe.operators import profiles as PR
from tallyframe.operators import sampling as S
from tallyframe.operators import text as TX
from tallyframe.sources import Snapshot
from tallyframe.sources.tables import SchemaDrift


def test_tolerant_numbers(spark):
    cases = {"2.5": 3, "-2.5": -3, "2.49999999999999999999": 2, "3.0": 3, "invalid": None, "": None, "9223372036854775807.0": 9223372036854775807, "9223372036854775808": None, "1e500": None, " 7 ": 7, None: None}
    for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parse_int(F.col("t")).alias("v")).collect():
        assert r.v == cases[r.t], r.t
    cases = {"35.1 in": 35.1, "--": None, " 42 in ": 42.0, "inf": None, "NaN": None, "1e500": None, "12 cm": None, None: None}
    for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parse_double(F.col("t"), "in").alias("v")).collect():
        assert r.v == cases[r.t], r.t


def test_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    with pytest.raises(J.CardinalityError):
        J.checked_join(left, right, ["k"], strict=True)
    with pytest.raises(PySparkException):
        J.checked_join(left, right, ["k"]).collect()
    assert J.checked_join(left, right.limit(1), ["k"]).count() == 3


def test_funnel_and_filters(spark):
    df = spark.createDataFrame([(10000, 20000), (20000, 50000), (30000, None)], "price int, mileage int")
    f = C.Filters({}, {}, {"price": 20000, "mileage": 50000})
    assert df.filter(f.expression()).count() == 2
    got = [(r.step, r.remaining, r.excluded) for r in C.funnel(df, [("price", F.col("price") <= 30000), ("miles", F.col("mileage") <= 50000)]).collect()]
    assert got == [("price", 3, 0), ("miles", 2, 1)]


def test_conflicts_are_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "b"), (None, "c"), (None, "d")], "k int, v string")
    assert {r.k for r in E.conflicting(df, ["k"], ["v"]).collect()} == {1, None}
    assert {r.k for r in E.without_conflicts(df, ["k"], ["v"]).collect()} == {2}


def test_balanced_opinions(spark):
    rows = [("large", "positive")] * 10 + [("small", "negative"), ("small", "no_opinion")]
    df = spark.createDataFrame([(v, "m", p) for v, p in rows], "video string, make string, p string")
    r = O.balanced(df, "video", ["make"], "p", 1, 1).first()
    assert (r.opinions, r.balanced_net, r.weighted_net) == (11, 0.0, round(9 / 11, 9))
    s = O.balanced(df, "video", ["make"], "p").first()
    assert s.balanced_net is None and s.support_suppressed and s.opinions == 11


def test_split_is_permutation_invariant(spark):
    rows = [(f"v{i}", "ABC"[i % 3] if i % 7 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "vin string, model string")
    a = {r.vin: r.split for r in S.stratified_split(df, ["model"], "vin").collect()}
    b = {r.vin: r.split for r in S.stratified_split(df.orderBy(F.rand(1)).repartition(3), ["model"], "vin").collect()}
    assert a == b and set(a.values()) <= {"fit", "validation", "test", "excluded"}


def test_quota_totals(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b" if i < 95 else "c") for i in range(100)], "k int, g string")
    q = {r.g: r.quota for r in S.quotas(df, ["g"], 30, 4).collect()}
    assert sum(q.values()) == 30 and q["c"] >= 4 and q["a"] > q["b"]


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 100.0), (200.0, 150.0), (300.0, 250.0)], "a double, p double")
    r = df.agg(*M.regression("a", "p")).first()
    assert (r.r2, r.wape_pct, r.bias) == (0.75, round(100 / 6, 6), round(-100 / 3, 6))
    assert df.limit(1).agg(*M.regression("a", "p")).first().r2 is None
    assert [x.band for x in spark.createDataFrame([(24999.0,), (25000.0,)], "x double").select(X.left_closed_band(F.col("x"), 25000).alias("band")).collect()] == [0.0, 25000.0]


def test_peers_against_all_pairs(spark):
    rows = [(i, f"f{i % 9}", "abc"[i % 3], 2000 + i % 20, float((i * 37) % 101), "xyz"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, fam string, body string, year int, hp double, drive string")
    got = {(r.id, r.peer): r.distance for r in P.nearest_peers(df, "id", "fam", ["body"], "year", 5, [(["hp"], ["drive"])], 3).collect()}
    b = P.numeric_bounds(df, ["hp"]).first()
    lo, hi = b[0], b[1]
    clip = lambda v: min(max(v, lo), hi)
    for i, fam, body, year, hp, drive in rows:
        best = {}
        for j, f2, b2, y2, h2, d2 in rows:
            if fam != f2 and body == b2 and abs(year - y2) <= 5:
                d = round((abs(clip(hp) - clip(h2)) / (hi - lo) + (drive != d2)) / 2, 9)
                best[f2] = min(best.get(f2, (9, 0)), (d, j))
        want = sorted(best.values())[:3]
        assert sorted((d, p) for (k, p), d in got.items() if k == i) == want


def test_relaxed_union_and_diff(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    b = spark.createDataFrame([("x", 1)], "v string, k int")
    assert {tuple(r) for r in J.union_relaxed(a, b).select("k", "v").collect()} == {(1, "2"), (1, "x")}
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    assert {tuple(r) for r in J.snapshot_diff(old, new, ["k"], ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_json_discovery_and_collision(spark):
    df = spark.createDataFrame([('{"a": 1, "m": 2, "make": "x"}', "src"), ('{"a": 2.5, "late": true, "m": "two"}', None), (None, None)], "j string, make string")
    kinds = {r.key: r.kind for r in CL.json_keys(df, "j").collect()}
    assert kinds == {"a": "float", "m": "text", "make": "text", "late": "bool"}
    out = CL.expand_json(df, "j", kinds)
    assert "json_make" in out.columns and out.filter("late").first().a == 2.5
    with pytest.raises(ValueError):
        CL.pivot_long(df, ["make"], "j", "j", ["A", "a"])


def test_clauses_keep_offsets(spark):
    t = "First one. Second; third!\n\n last"
    for r in TX.clauses(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), "k", "t").collect():
        assert t[r.start : r.end] == r.clause


def test_receipts(spark, tmp_path):
    df = spark.range(5)
    MF.publish(df, str(tmp_path / "t.parquet"))
    MF.publish(df.limit(2), str(tmp_path / "t.parquet"))
    MF.write_manifest(spark, str(tmp_path), ["t"])
    assert Snapshot(spark, str(tmp_path)).scan("t").count() == 2
    MF.publish(df.withColumn("x", F.lit(1)), str(tmp_path / "t.parquet"))
    with pytest.raises(SchemaDrift):
        Snapshot(spark, str(tmp_path))
    stage = MF.Stage(str(tmp_path / "s"), {"in": "1"})
    assert stage.begin()
    (tmp_path / "s" / "out.json").write_text(json.dumps({"a": 1}))
    stage.finish()
    stage.verify()
    (tmp_path / "s" / "out.json").write_text("{}")
    with pytest.raises(ValueError):
        stage.verify()


def test_checks_and_fingerprint(spark):
    df = spark.createDataFrame([(i, str(i % 4)) for i in range(40)], "a int, b string")
    assert CH.fingerprint(df).collect() == CH.fingerprint(df.repartition(7)).collect()
    assert CH.row_difference(df, df.orderBy(F.col("a").desc())).count() == 0
    assert CH.violations("x", df.limit(0)).first().status == "pass"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, g string, v double, d date")
    assert C.cohort_summary(empty, ["g"], "v").count() == 0
    assert S.stratified_split(empty, ["g"], "k").count() == 0
    assert O.balanced(empty.withColumn("p", F.lit("positive")), "k", ["g"], "p").count() == 0
    assert E.versions(empty, ["k"], ["v"]).count() == 0
    assert C.scope_summary(empty, "k", ["g"], ["v"], "d").first().n_rows == 0
    assert dt.date.today() and CL.key_quality(empty, ["k"]).first().n_keys == 0


def test_unresolved_and_empty_opinions(spark):
    rows = [("v1", "a", "positive"), ("v1", "a", "unresolved"), ("v2", "a", "unresolved"), ("v2", "a", None), ("v3", "a", "negative"), ("v3", "a", "mixed"), ("v4", "b", "unresolved"), ("v4", "b", "no_opinion")]
    df = spark.createDataFrame(rows, "video string, make string, p string")
    got = {r.make: r for r in O.balanced(df, "video", ["make"], "p", 1, 1).collect()}
    a, b = got["a"], got["b"]
    assert (a.opinions, a.units, a.observed_units, a.unresolved, a.balanced_net, a.weighted_net) == (3, 2, 3, 2, 0.25, 0.0)
    assert (b.opinions, b.units, b.observed_units, b.balanced_net, b.support_suppressed, b.unresolved_share) == (0, 0, 1, None, True, 0.5)
    sets = {"x": [None], "y": ["neutral", "unresolved"], "z": ["positive", "negative", "mixed"], "m": ["mixed"], "n": ["no_opinion", "negative"]}
    c = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, p string").groupBy("k").agg(O.collapse("p").alias("c"))
    assert {r.k: r.c for r in c.collect()} == {"x": "unresolved", "y": "unresolved", "z": "mixed", "m": "neutral", "n": "negative"}


def test_calendar_windows(spark):
    days = ["2023-02-28", "2023-03-01", "2024-02-29", "2024-03-01", "2025-02-28", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("to_date(d) AS d")
    got = {(str(r.d), str(r.window_end)) for r in O.in_windows(df, O.window_ends(df, "d"), "d", 12).collect()}
    assert ("2023-02-28", "2024-01-31") in got and ("2023-02-28", "2024-02-29") not in got
    assert ("2023-03-01", "2024-02-29") in got and ("2023-03-01", "2024-03-31") not in got
    assert ("2024-02-29", "2025-01-31") in got and ("2024-02-29", "2025-02-28") in got and len({w for _, w in got}) == 25


def test_parent_states(spark):
    cases = {"a": [("ev", 3), ("unknown", 212)], "b": [("ev", 99), ("ice", 1)], "c": [("ev", 99), ("conflicting", 1)], "d": [("ev", 90), (None, 10)], "e": [(None, 5)], "f": [("x", 1), ("y", 1), ("z", 98)]}
    df = spark.createDataFrame([(k, lab, w) for k, v in cases.items() for lab, w in v], "k string, l string, w bigint")
    got = {r.k: (r.state, r.assigned_label) for r in PR.parent_state(df, ["k"], "l", "w").collect()}
    assert got == {"a": ("insufficient_evidence", None), "b": ("mixed", None), "c": ("conflicting", None), "d": ("assigned", "ev"), "e": ("insufficient_evidence", None), "f": ("mixed", None)}


def test_rule_labels_against_python(spark):
    rules = {"brake": r"\bbrak\w*", "fire": r"\b(?:fire|ignit\w*)\b", "delay": r"\bdelay\w*"}

    def brute(text):
        out = []
        for name, pattern in sorted(rules.items()):
            for m in re.finditer(pattern, text.lower()):
                before = re.split(r"[.;!?]", text.lower()[max(0, m.start() - 45) : m.start()])[-1]
                denied = re.search(r"\b(no|not|never|without)\b(?:\W+\w+){0,3}\W*$", before)
                supposed = re.search(r"\b(could|may|might|would|will|risk of|worried about)\b", before)
                if name == "delay" or not (denied or supposed):
                    out.append(name)
                    break
        return out

    words = ["no", "not", "brakes", "Brake", "fire", "the", "car", "never", "without", "delayed", "could", "risk of", "ignited", "failed", ".", ";", "!", ",", "a very long descriptive wording", "é"]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "Not one of them. Brakes failed", "x" * 5000 + " brake"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.got for r in df.select("i", TX.rule_labels(F.col("t"), rules, True, ("delay",)).alias("got")).collect()}
    assert all(got[i] == brute(t) for i, t in enumerate(texts)) and got[len(texts)] is None


def test_mask_for_model(spark):
    cases = [
        ("The Calder ALBA of 2015 (12V123456) rang 312-555-0192; VIN 1HGCM82633A004352 ok", "the vehicle vehicle of ( ) rang ; vin ok"),
        ("Ünïcode 1999ers 1850 2100 café", "ünïcode 1999ers 1850 2100 café"), ("calderas Ab", "calderas ab"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(t, "Calder", "Alba" if i < 2 else "Ab", w) for i, (t, w) in enumerate(cases)], "t string, make string, model string, want string")
    for r in df.withColumn("got", TX.mask_for_model(F.col("t"), [F.col("make"), F.col("model")])).collect():
        assert r.got == r.want


def test_wilson_ends(spark):
    r = spark.sql("SELECT 0D AS h, 0D AS n, 30D AS k").select(*[c.alias(f"c{i}") for i, c in enumerate([*M.wilson(F.col("h"), F.col("n")), *M.wilson(F.col("k"), F.col("k")), M.wilson_gate(F.col("k"), F.col("k"), 0.9, 0.85), M.wilson_gate(F.col("h"), F.col("n"), 0.0, 0.0)])]).first()
    assert (r.c0, r.c1, round(r.c2, 6), r.c3, r.c4, r.c5) == (0.0, 1.0, 0.886487, 1.0, True, False)
    w = spark.createDataFrame([(-100.0, 1.0), (50.0, 2.0)], "a double, p double").agg(*M.regression("a", "p")).first()
    assert w.wape_pct is None
