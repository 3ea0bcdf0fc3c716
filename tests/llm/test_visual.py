import random

from tallyframe.llm import visual as V


def test_forms():
    same = ["résumé", "résumé", "r​ésumé", "ｒésumé", "rés­umé"]
    assert len({V.canonical(x, fold=False) for x in same}) == 1
    assert V.canonical("ﬁle x y") == "file x y"
    assert V.canonical("аdmin") == "admin" and V.canonical("Аdmin", fold=False) == "Admin"
    assert V.canonical("STRASSE") == V.canonical("Straße")
    for a, b in (("resume", "résumé"), ("Ab", "ab"), ("a1", "a2"), ("a b", "a  b"), ("a\tb", "a b")):
        assert V.canonical(a, fold=False) != V.canonical(b, fold=False)
    rng = random.Random(1)
    chars = [chr(c) for c in range(32, 0x24F)] + list(V.LOOKALIKES) + [chr(c) for lo, hi in V.IGNORABLE[:9] for c in (lo, hi)] + ["́", "̈", "ﬁ", "Ａ"]
    for _ in range(500):
        t = "".join(rng.choice(chars) for _ in range(12))
        for fold in (True, False):
            once = V.canonical(t, fold)
            assert V.canonical(once, fold) == once


def test_pairs_against_brute_force(spark):
    texts = ["resume file", "résumé", "résumé", "résumé", "RÉSUMÉ", "x y", "x y", "x y", "x y", "аb", "ab", "", None, "ab", "​", "long " * 20000, "long " * 20000]
    df = spark.createDataFrame([(i, t, "l", "f") for i, t in enumerate(texts)], "doc_id bigint, text string, look string, fold string")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] and texts[b] and texts[a] != texts[b] and V.canonical(texts[a], fold=False) == V.canonical(texts[b], fold=False)}
    rows = [tuple(r) for r in V.lookalike_pairs(df, "doc_id", "text").collect()]
    assert set(rows) == want and len(rows) == len(want) > 5
    assert V.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "ＡB"), (2, None), (3, ""), (4, "AbC"), (4, "AbC")], "k int, t string")
    assert sorted((r.k, r.text_form or "") for r in V.normalise(df, ["k"], "t").collect()) == [(1, "ab"), (2, ""), (3, ""), (4, "abc"), (4, "abc")]


def test_more_scripts():
    assert V.canonical("Ꮪᴏᴜᴘ", fold=False) != "Soup" and V.canonical("Ꮪᴏᴜp", fold=False) == "Soup"
    assert V.canonical("ꓢOUP", fold=False) == "SOUP" and V.canonical("ꭰay") == V.canonical("Day")
    assert len(V.LOOKALIKES) < 200


def test_classes_against_brute_force(spark):
    texts = ["résumé", "résumé", "résumé", "résumé", "RÉSUMÉ", "x y", "x y", "x y", "alone", "", None, "alone"]
    df = spark.createDataFrame([(i, t, 0, "f") for i, t in enumerate(texts)], "doc_id bigint, text string, links int, fold string")
    look = {i: V.canonical(t, fold=False) for i, t in enumerate(texts) if t}
    want = sorted((i, min(j for j in look if look[j] == look[i]), sum(look[j] == look[i] and texts[j] != texts[i] for j in look), sum(texts[j] == texts[i] for j in look) - 1) for i in look)
    for hot in (1, 3, 1000):
        assert sorted(tuple(r) for r in V.lookalike_classes(df, "doc_id", "text", hot).collect()) == want
    assert V.lookalike_classes(df.limit(0), "doc_id", "text").count() == 0


def test_hundred_thousand_copies(spark):
    df = spark.range(100_000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'c\u00f3py' ELSE 'co\u0301py' END AS text")
    got = V.lookalike_classes(df, "doc_id", "text")
    assert got.agg({"class_id": "max", "links": "sum"}).first().asDict() == {"max(class_id)": 0, "sum(links)": 2 * 99_999}
    assert V.lookalike_pairs(df, "doc_id", "text").count() == 99_999
