import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import catalog as C
from tallyframe.operators import clean as CL
from tallyframe.operators import joins as J
from tallyframe.operators import manifest as MF
from tallyframe.operators import metrics as M
from tallyframe.operators import ml
from tallyframe.operators import peers as P
from tallyframe.operators import profiles as PR
from tallyframe.operators import sampling as S
from tallyframe.sources import readers as R


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('vin,price\n007,"1,5"\n008,\n')
    df = R.read_csv_text(spark, str(tmp_path / "a.csv"), ["vin", "price"])
    assert [(r.vin, r.price) for r in df.collect()] == [("007", "1,5"), ("008", None)]
    with pytest.raises(ValueError):
        R.read_csv_text(spark, str(tmp_path / "a.csv"), ["price", "vin"])
    assert R.declared_schema([("a", "TEXT"), ("b", "integer")]).simpleString() == "struct<a:string,b:bigint>"
    with pytest.raises(ValueError):
        R.declared_schema([("a", "BLOB")])
    html = "<table><tr><th>Engine</th><td>2.0 <b>L</b> &amp; more</td></tr><tr><td>Engine</td><td>3.0</td></tr><tr><td>only</td></tr></table>"
    rows = spark.createDataFrame([(html,), (None,), ("<p>no table",)], "h string").select(R.html_table_pairs(F.col("h")).alias("m")).collect()
    assert [r.m for r in rows] == [{"Engine": "2.0 L & more"}, None, {}]
    assert sqlite3.sqlite_version and dt


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "q int, v string")
    MF.upsert_partition(a, str(tmp_path / "p"), "q")
    MF.upsert_partition(spark.createDataFrame([(2, "z")], "q int, v string"), str(tmp_path / "p"), "q")
    assert {(r.q, r.v) for r in R.read_shards(spark, str(tmp_path / "p")).withColumn("q", F.regexp_extract(F.input_file_name(), r"q=(\d+)", 1).cast("int")).collect()} == {(1, "x"), (2, "z")}
    MF.write_report(a, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    with pytest.raises(ValueError):
        MF.publish_checked(a.union(a), str(tmp_path / "t.parquet"), ["q"])
    MF.publish_checked(a, str(tmp_path / "t.parquet"), ["q"], {"q": (1, 2)})


def test_names_and_scopes(spark):
    df = spark.createDataFrame([(1, "2.5"), (2, "3")], "vpic_a int, b string")
    assert CL.strip_prefix(df, "vpic_").columns == ["a", "b"]
    with pytest.raises(ValueError):
        CL.strip_prefix(df.withColumn("vpic_B", F.lit(1)), "vpic_")
    with pytest.raises(ValueError):
        CL.select_policy(df, ["b", "c"])
    assert CL.select_policy(df, ["b", "c"], require_all=False).columns == ["b", "c"]
    assert CL.convert_if_representable(df, "b", F.col("b").try_cast("int")).dtypes[1][1] == "string"
    assert CL.convert_if_representable(df, "b", F.col("b").try_cast("double")).dtypes[1][1] == "double"
    assert C.broaden(df, [("tight", F.col("vpic_a") == 1), ("all", F.lit(True))], 2)[0] == "all"


def test_reconcile(spark):
    df = spark.createDataFrame([(100.0, 104.0), (100.0, 200.0), (None, 5.0), (None, None)], "a double, b double")
    v, s = PR.reconcile_numeric(F.col("a"), F.col("b"), 5, 0.05)
    assert [(r.v, r.s) for r in df.select(v.alias("v"), s.alias("s")).collect()] == [(100.0, "agree"), (None, "conflict"), (5.0, "second_only"), (None, "missing")]
    v, s = PR.reconcile_label(F.col("a"), F.col("b"))
    assert df.select(v.alias("v"), s.alias("s")).collect()[1].s == "conflict"


def test_inflation(spark):
    import random

    rng = random.Random(2)
    rows = [(x := rng.random(), x + rng.gauss(0, 0.1), rng.random()) for _ in range(400)]
    v = M.inflation(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert v["a"] > 5 and v["b"] > 5 and v["c"] < 1.2


def test_range_join_buckets_agree(spark):
    left = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(-20, 60)], "x int, g string")
    ranges = spark.createDataFrame([("a", -5, 10), ("a", 8, 30), ("b", 0, 0), ("b", 50, 90)], "g string, lo int, hi int")
    plain = sorted(tuple(r) for r in J.range_join(left, ranges, ["g"], "x", "lo", "hi", "inner").select("x", "g", "lo").collect())
    assert plain == sorted(tuple(r) for r in J.range_join(left, ranges, ["g"], "x", "lo", "hi", "inner", bucket=7).select("x", "g", "lo").collect())


def test_clusters_reject(spark):
    rows = [(float(i % 3 * 10 + (i % 7) / 10), "a") for i in range(90)]
    c = ml.cluster(spark.createDataFrame(rows, "x double, k string"), ["x"], ["k"], 3)
    assert c.select("cluster").distinct().count() == 3 and ml.silhouette(c) > 0.8
    from pyspark.ml.stat import Summarizer

    centres = [r.m for r in c.groupBy("cluster").agg(Summarizer.mean(F.col("features")).alias("m")).orderBy("cluster").collect()]
    out = ml.reject_far(c, centres, 0.6)
    assert 0 < out.filter("assigned IS NULL").count() <= 36


def vectors(spark, n=1500, seed=3):
    import random

    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [float(c + rng.gauss(0, 0.6)) for c in centres[i % 12 if i % 3 else 0]]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * 16)], "id bigint, v array<float>")


def test_neighbours(spark):
    import numpy as np

    df = vectors(spark)
    asked = df.filter("id % 50 = 0")
    exact = {}
    for r in P.neighbours_of(df, asked, "id", "v", 5, block=7).collect():
        exact.setdefault(r.query_id, {})[r.rank] = r.neighbour
    rows = {r.id: np.array(r.v, dtype=float) for r in df.filter("v IS NOT NULL").collect()}
    unit = {i: x / (np.linalg.norm(x) or 1) for i, x in rows.items()}
    for qid, got in exact.items():
        want = sorted((-round(float(unit[qid] @ u), 9), i) for i, u in unit.items() if i != qid)[:5]
        assert [got[k] for k in sorted(got)] == [i for _, i in want]
    hit = total = 0
    for r in P.indexed_neighbours(df, asked, "id", "v", 5).collect():
        hit += r.neighbour in exact[r.query_id].values()
    total = sum(len(v) for v in exact.values())
    assert hit / total >= 0.9
    assert P.neighbours_of(df, asked.limit(0), "id", "v", 5).count() == 0



def test_indexed_recall_without_clusters(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(2000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    asked = df.filter("id % 50 = 0")
    exact = {(r.query_id, r.neighbour) for r in P.neighbours_of(df, asked, "id", "v", 10).collect()}
    got = {(r.query_id, r.neighbour) for r in P.indexed_neighbours(df, asked, "id", "v", 10).collect()}
    assert len(exact) == 400 and len(exact & got) / 400 >= 0.9



def test_topics_use_every_document(spark):
    from pyspark.ml.functions import vector_to_array

    # sixty documents of one common stock of words, and two whose words stand nowhere else
    rows = [(i, "brake pedal brake noise pedal") for i in range(60)] + [(100, "zyxo quarl"), (101, "velmi torpan"), (102, None)]
    t = ml.topics(spark.createDataFrame(rows, "id int, s string"), "s", 2).withColumn("p", vector_to_array("topics"))
    got = {r.id: r.p for r in t.collect()}
    assert len(got) == 63 and all(max(got[i]) > 0.55 for i in (0, 100, 101))



def test_text_classifier_folds(spark):
    rows = [(i, f"{'brak' if i % 2 else 'motor'}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i} was here", float(i % 2), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, s string, y double, fold int")
    got = {r.id: r.probability_1 for r in ml.text_classifier(df, "s", "y", "fold", 3).collect()}
    # words differ in every row, so only parts of words tell the label of a row left out
    assert len(got) == 90 and sum((got[i] > 0.5) == bool(i % 2) for i in got) >= 85
    # held-out texts change nothing in the scores of the others of their fold
    other = df.withColumn("s", F.when(F.col("id").isin(0, 3, 6), "motor brak was was").otherwise(F.col("s")))
    again = {r.id: r.probability_1 for r in ml.text_classifier(other, "s", "y", "fold", 3).collect()}
    assert all(abs(got[i] - again[i]) < 1e-9 for i in range(9, 90, 3))


def test_split_rank_equals_window(spark):
    from pyspark.sql import Window as W

    df = spark.createDataFrame([(i, "hot" if i % 3 else [None, "a", "b"][i % 9 // 3]) for i in range(900)], "k int, g string")
    ranked = S.hash_rank(df, ["g"], "k", "42", "r", "n")
    from tallyframe.functions.expr import sha_hex

    plain = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(sha_hex("k", salt="42"), "k"))).withColumn("n", F.count("*").over(W.partitionBy("g")))
    assert sorted(map(tuple, ranked.select("k", "r", "n").collect())) == sorted(map(tuple, plain.select("k", "r", "n").collect()))


def test_diverse_top_fills(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 100 - i) for i in range(20)], "k int, f string, v int")
    got = [r.k for r in P.diverse_top(df, "f", [F.col("v").desc(), F.col("k")], 5).collect()]
    assert got == [0, 1, 2, 3, 4]
    wide = spark.createDataFrame([(i, f"f{i // 10}", 1000 - i) for i in range(100)], "k int, f string, v int")
    assert [r.k for r in P.diverse_top(wide, "f", [F.col("v").desc(), F.col("k")], 4).collect()] == [0, 10, 20, 30]


def test_models_of_empty_tables(spark):
    e = spark.createDataFrame([], "x double, k string, t string, y double, fold int")
    assert ml.cluster(e, ["x"], ["k"], 2).select("cluster").count() == 0
    assert ml.log_price_model(e, e, "y", ["x"], ["k"]).select("prediction").count() == 0
    assert ml.tfidf(e, "t").select("tfidf").count() == 0
    assert ml.project(e, ["x", "y"]).select("projection").count() == 0
    assert ml.topics(e, "t", 2).select("topics").count() == 0
    assert ml.text_classifier(e, "t", "y", "fold", 2).select("probability_1").count() == 0


def test_join_ignores_null_keys_of_the_one_side(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, r string")
    assert sorted((r.l, r.r) for r in J.checked_join(left, right, ["k"]).collect()) == [("a", "x"), ("b", None)]


def test_ranked_peers(spark):
    """Window that widens, missing fields, statuses, one per family, categories and clusters."""
    rows = [(f"q{i}", f"f{i}", "x", 2000 + i, float(i), None if i == 3 else "g", {"a": 1.0} if i % 2 else {"b": 1.0}, i % 3, True) for i in range(12)]
    rows += [("twin", "f1", "x", 2001, 1.0, "g", {"a": 1.0}, 1, True), ("lone", "l", "y", 2000, 1.0, "g", None, None, True), ("bare", "b", "x", 2005, None, None, None, None, True), ("out", "o", "x", 2003, 3.0, "g", None, None, False), ("late", "z", "x", None, 3.0, "g", None, None, True)]
    df = spark.createDataFrame(rows, "id string, fam string, kind string, year int, size double, gear string, cats map<string,double>, cl int, ok boolean")
    peers, statuses = P.ranked_peers(df, "id", "fam", ["kind"], "year", (2, 5, 10), [(["size"], [], 1), ([], ["gear"], 1)], P.APPROACHES[:4], k=5, categories=["cats"], clusters=["cl"], eligible="ok")
    got = {}
    for r in peers.orderBy("peer_rank").collect():
        got.setdefault((r.id, r.approach), []).append(r)
    st = {(r.id, r.approach): (r.status, r.slate_size, r.window) for r in statuses.collect()}
    assert len(st) == 4 * len(rows)
    assert st["lone", "direct"][0] == "no_compatible_family" and st["out", "direct"][0] == "query_ineligible" and st["late", "direct"][0] == "query_ineligible"
    assert st["bare", "direct"] == ("no_shared_evidence", 0, 10.0) and st["q3", "direct"][0] == "no_shared_evidence"
    assert st["q0", "direct"] == ("complete", 5, 10.0) and [r.peer for r in got["q0", "direct"]] == ["q1", "q2", "q4", "q5", "q6"]
    assert st["q6", "direct"] == ("complete", 5, 5.0)
    assert all(len({r.peer for r in v} & {"q1", "twin"}) < 2 for v in got.values())
    first = got["q0", "categories_clusters"][0]
    assert first.ranking_distance != got["q0", "direct"][0].ranking_distance
    assert P.ranked_peers(df.limit(0), "id", "fam", ["kind"], "year", (2,), [(["size"], [])])[0].count() == 0
    c = {r.approach: r for r in P.compare_approaches(peers, "id", "direct").collect()}
    assert c["direct"].mean_overlap == 1.0 and set(c) == {"direct", "categories", "clusters", "categories_clusters"}


def test_missing_numbers_are_not_shared(spark):
    df = spark.createDataFrame([("a", "f", "x", 1.0, None), ("b", "g", "x", 1.0, 2.0), ("c", "h", "x", 1.0, 5.0)], "id string, fam string, kind string, y double, v double")
    got = {(r.id, r.peer) for r in P.nearest_peers(df, "id", "fam", ["kind"], "y", 1.0, [(["v"], [])]).collect()}
    assert got == {("b", "c"), ("c", "b")}
