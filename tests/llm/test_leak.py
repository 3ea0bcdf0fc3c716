import random

import numpy as np

from tallyframe.llm import leak as L

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed=2):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            n = rng.choice([8, 11, 12, 13, 20])
            s = rng.randint(0, max(0, len(w) - n))
            text[len(text) // 2 : len(text) // 2] = w[s : s + n]
        docs.append((d, "\n+ ".join(" ".join(text[i : i + 7]).upper() for i in range(0, len(text), 7))))
    return docs, items


def near(a, b, k):
    return L.edit_distance(np.array([hash(x) for x in a]), np.array([hash(x) for x in b]), k) <= k


def test_exact_passages(spark):
    docs, items = corpus()
    docs += [(500, None), (501, ""), (502, docs[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items + [(99, None), (98, "too short")], "item_id bigint, text string")
    want = set()
    for d, t in docs:
        w = L.words(t)
        for i, x in items:
            y = L.words(x)
            if {tuple(w[j : j + 12]) for j in range(len(w) - 11)} & {tuple(y[j : j + 12]) for j in range(len(y) - 11)}:
                want.add((d, i))
    rows = [(r.doc_id, r.item_id) for r in L.find_leaks(df, it).collect()]
    assert set(rows) == want and len(rows) == len(want) > 10
    assert L.find_leaks(df.limit(0), it).count() == 0
    assert L.find_leaks(df, it.limit(0)).count() == 0


def test_joined_in_shuffle(spark):
    """Item tables too large to broadcast give the same rows."""
    docs, items = corpus(6)
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for edits in (0, 1):
        a, b = (sorted(tuple(r) for r in L.find_leaks(df, it, max_edits=edits, broadcast_rows=n).collect()) for n in (0, 10**6))
        assert a == b and len(a) > 10


def test_recall_at_a_thousand_edits(spark):
    """The registered setting (one edit) on 1000 seeded passages, and two edits."""
    rng = random.Random(21)
    for edits in (1, 2):
        docs, items = [], []
        for i in range(1000):
            w = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([12, 20, 30]))]
            items.append((i, " ".join(w)))
            s = rng.randrange(len(w) - 11)
            p = w[s : s + 12]
            for _ in range(edits):
                at = rng.randrange(len(p))
                p[at : at + rng.randint(0, 1)] = [] if rng.random() < 0.3 else ["zzz"]
            docs.append((i, " ".join(["pad"] * 20 + p + ["pad"] * 20)))
        got = L.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_edits=edits)
        assert got.filter("doc_id = item_id").count() >= 950


def test_short_items_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox jumps over it"), (2, "the quick brown ox jumps over")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over")], "item_id bigint, text string")
    assert L.find_leaks(docs, items, max_edits=1).count() == 0
    assert sorted((r.doc_id, r.min_edits) for r in L.find_leaks(docs, items, max_edits=1, shortest=6).collect()) == [(1, 0), (2, 1)]


def test_near_passages_recall(spark):
    rng = random.Random(9)
    docs, items, truth = [], [(i, " ".join(rng.choice(WORDS) for _ in range(14))) for i in range(60)], 0
    for i, t in items:
        w = t.split()[:12]
        op = i % 3
        if op == 0:
            w[rng.randrange(12)] = "zzz"
        elif op == 1:
            del w[rng.randrange(1, 11)]
        else:
            w.insert(rng.randrange(1, 11), "zzz")
        docs.append((i, " ".join(["pad"] * 15 + w + ["pad"] * 15)))
        truth += 1
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.min_edits for r in L.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), max_edits=2).collect()}
    assert sum((i, i) in got for i in range(60)) >= 0.95 * truth
    assert all(e <= 2 for e in got.values())


def test_one_edit_at_every_place(spark):
    rng = random.Random(4)
    docs, items, kinds = [], [], []
    for n in (12, 14):
        for kind in ("changed", "missing", "added"):
            for place in range(1 if kind == "added" else 0, n):
                for _ in range(5):
                    w = [rng.choice(WORDS) for _ in range(n)]
                    items.append((len(items), " ".join(w)))
                    w[place : place + (kind != "added")] = [] if kind == "missing" else ["zzz"]
                    kinds.append(kind)
                    docs.append((len(docs), " ".join(w if len(docs) % 2 else ["pad"] * 15 + w + ["pad"] * 15)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = L.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), max_edits=1).filter("doc_id = item_id").collect()
    assert all(r.min_edits <= 1 for r in got)
    for kind in set(kinds):
        assert sum(kinds[r.doc_id] == kind for r in got) >= 0.95 * kinds.count(kind), kind


def test_words_ignore_marks():
    assert L.words("+ The Qu­ick\n// ＢROWN_fox's") == ["the", "quick", "brown", "fox", "s"]


def test_distances_at_once():
    rng = np.random.default_rng(5)
    for n, m in ((5, 5), (5, 6), (4, 6), (3, 9), (1, 1)):
        a, b = rng.integers(0, 3, (200, n)).astype(np.uint64), rng.integers(0, 3, (200, m)).astype(np.uint64)
        for limit in (0, 1, 2, 3):
            assert L.edit_distances(a, b, limit).tolist() == [L.edit_distance(x, y, limit) for x, y in zip(a, b)]


def test_gram_rule_loses_nothing():
    rng = random.Random(8)
    for _ in range(3000):
        n, edits = rng.randint(4, 14), rng.randint(0, 2)
        a = [rng.randrange(9) for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [] if rng.random() < 0.4 and len(b) > 1 else [99]
        q, _ = L.gram_rule(n, edits)
        grams = {tuple(a[i : i + q]) for i in range(n - q + 1)}
        shared = sum(tuple(b[i : i + q]) in grams for i in range(len(b) - q + 1))
        assert shared >= max(n, len(b)) - q + 1 - q * edits
