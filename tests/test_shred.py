import json
import random

from tallyframe.operators import shred as S


def brute(rec, path):
    cur = [((), rec)]
    for step in path.split("."):
        nxt = []
        for pos, o in cur:
            o = json.loads(o) if isinstance(o, str) and o[:1] == "{" else o
            if not isinstance(o, dict):
                continue
            v = next((o[k] for k in o if k.lower() == step), None)
            v = json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v
            if isinstance(v, dict):
                v = [v[k] for k in sorted(v, key=int)] if v and all(k.isdigit() for k in v) else [v]
            nxt += [(pos + (i,), x) for i, x in enumerate(v)] if isinstance(v, list) else []
        cur = nxt
    return [(p, x) for p, x in cur if isinstance(x, dict) and x]


def random_array(rng, depth, names):
    items = []
    for _ in range(rng.randint(0, 3)):
        r = rng.random()
        if r < 0.15:
            items.append(rng.choice([None, {}, 5, "txt"]))
        else:
            o = {"v": rng.choice([1, None, "a", True])}
            if depth < len(names):
                key = rng.choice([names[depth], names[depth].upper(), names[depth].title()])
                o[key] = random_array(rng, depth + 1, names)
            items.append(o)
    r = rng.random()
    if r < 0.2:
        return {str(i): x for i, x in enumerate(items)}
    if r < 0.35:
        return json.dumps(items)
    if r < 0.45 and len(items) == 1 and isinstance(items[0], dict):
        return items[0]
    return rng.choice([items, items, items, None])


def test_random_round_trip():
    rng, names = random.Random(7), ["products", "components", "events"]
    groups = [".".join(names[: i + 1]) for i in range(3)]
    recs = []
    for _ in range(500):
        rec = {"id": 1, "products": random_array(rng, 1, names)}
        recs.append(rec)
    cols = S.shred(recs, groups)
    for g in groups:
        entries, record, places = S.rebuild(cols[g])
        got = [(int(i), tuple(p)) for i, p in zip(record, places.tolist())]
        want = [(i, p, x) for i, rec in enumerate(recs) for p, x in brute(rec, g)]
        assert got == [(i, p) for i, p, _ in want]
        leaf = cols[g].leaf("v")
        assert len(leaf) == len(cols[g].repetition)
        for e, (_, _, obj) in zip(entries, want):
            rep, definition, value = leaf[e]
            assert rep == cols[g].repetition[e] and definition == S.Group(g).depth + (2 if value is not None else 1)
            assert value == (None if obj.get("v") is None else obj["v"] if isinstance(obj["v"], str) else json.dumps(obj["v"]))


def test_envelopes_and_edges(spark):
    rows = [
        (1, '{"record": {"products": [{"a": 1}]}}'), (2, '{"Count": 1, "Results": {"item": {"PRODUCTS": {"a": 1}}}}'), (3, '{"products": [{"a": 1'), (4, None), (5, ""), (6, '{"products": [null, {}, {"a": null}]}'),
        (7, "[1, 2]"), (8, '{"products": "not an array"}'), (1, '{"record": {"products": [{"a": 1}]}}'), (9, '{"products": {"10": {"a": 1}, "9": {"b": 1}}}'),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "row_id bigint, j string, pos_path string")
    got = sorted((r.row_id, r.pos_path) for r in S.shred_tables(df, "row_id", "j", ["products"]).collect())
    assert got == [(1, "0"), (1, "0"), (2, "0"), (6, "2"), (9, "0"), (9, "1")]
    assert S.shred_tables(df.limit(0), "row_id", "j", ["products"]).count() == 0
    plain = S.shred_tables(df, "row_id", "j", ["products"], fields=False)
    assert plain.columns == ["row_id", "array_path", "pos_path", "parent_path"] and plain.count() == 6
    deep = "[" * 3000 + "]" * 3000
    assert S.parse_record(deep) is None


def test_envelopes_of_any_size():
    inner = {"products": [{"a": 1}]}
    rec = inner
    for _ in range(30):
        rec = {"record": rec, **{f"k{i}": i for i in range(9)}}
    assert S.parse_record(json.dumps(rec)) == inner
    assert S.parse_record(json.dumps(json.dumps({"Items": [inner], "n": 1}))) == inner
    kept = {"products": "[{}]", "data": {"x": 1}}
    assert S.parse_record(json.dumps(kept), frozenset({"products"})) == kept
    many = {"data": [1, 2], "x": 1}
    assert S.parse_record(json.dumps(many)) == many
