import os
import random

import pytest

from tallyframe.llm import mix as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="needs the tokenizer files")


def test_shares_and_caps(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randint(0, 60), "big" if i % 10 else "small" if i % 20 else None) for i in range(2000)] + [(5000, None, "big"), (5001, "", "big"), (1, "word " * 9, "big")]
    targets = [("m", "big", 0.6, 1, 1.0), ("m", "small", 0.4, 3, 1.0), ("n", "big", 3.0, None, 2.0), ("n", "gone", 1.0, 2, 2.0), ("z", "big", -1.0, 1, 1.0), ("t", "small", 1.0, 5, 0.01)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, copies string")
    tg = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats bigint, size_ratio double")
    drawn, report = M.draw_mixes(df, tg)
    rows = drawn.collect()
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert len(rep) == len(targets)
    largest = max(r.tokens for r in rows)
    for (m, s), r in rep.items():
        mine = [x for x in rows if (x.mix_name, x.source) == (m, s)]
        assert r.drawn_tokens == sum(x.tokens * x.copies for x in mine) <= max(0, r.target_tokens)
        cap = {(t[0], t[1]): t[3] for t in targets}[m, s]
        assert all(1 <= x.copies and (cap is None or x.copies <= cap) for x in mine)
        if r.available_tokens and (cap is None or r.target_tokens < cap * r.available_tokens):
            assert r.target_tokens - r.drawn_tokens <= max(largest, 0)
        if mine:
            assert max(x.copies for x in mine) - min(x.copies for x in mine) <= 1
    assert rep["m", "small"].max_copies == 3 and rep["n", "gone"].shortfall_tokens > 0 and rep["z", "big"].drawn_tokens == 0
    for m in {t[0] for t in targets}:
        assert abs(sum(r.actual_share for k, r in rep.items() if k[0] == m) - 1) < 1e-9 or not any(r.drawn_tokens for k, r in rep.items() if k[0] == m)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    tg = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats bigint, size_ratio double")
    drawn, report = M.draw_mixes(df, tg)
    assert drawn.count() == 0 and report.first().drawn_tokens == 0


def test_token_counts(spark):
    from pyspark.sql import functions as F

    rows = [("", 0), (None, 0), ("hello world", 2), ("<|endoftext|>", 7)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(M.token_count_udf(M.TOKENIZER)(F.coalesce("t", F.lit(""))).alias("n")).collect()
    assert [r.n for r in got] == [n for _, n in rows]
