"""Mixing sources to target weights, by hash-threshold histograms.

Tokens are summed by source and hash bucket. The buckets nest, so each mix's budget of a source is a
threshold on the hash: whole buckets below it, and only the bucket it falls into is counted again by
finer buckets. Drawing is then a filter; nothing is sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # default of the path parameter
LEVELS = (12, 12, 12)  # bits per level of buckets


# Fixed value: the pattern that splits texts for this vocabulary, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    """Byte-level vocabulary of ranks, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count_udf(path: str):
    """Arrow UDF: tokens of a text by a public vocabulary of ranks; null and empty texts have 0. Names of
    special tokens are ordinary text."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for s in batches:
            codes, values = pd.factorize(s)
            sizes = [len(enc.encode_ordinary(v)) for v in values] + [0]
            yield pd.Series([sizes[c] for c in codes], dtype="int64")

    return run


def mix_hash(key: Column, seed: str) -> Column:
    """36 random-looking bits of a row, the same for every mix: budgets of one source nest."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key.cast("string")), 64 - sum(LEVELS))


@dataclass
class Draw:
    """Of one source in one mix: ``full`` copies of every row, one more where hash < ``threshold``."""

    mix: str
    source: str
    share: float
    budget: float
    available: int
    cap: int | None
    full: int = 0
    threshold: int = 0
    below: int = 0  # tokens known to lie below the threshold
    rest: float = 0.0


def _histogram(sizes: DataFrame, boundary: set[tuple[str, int]] | None, shift: int) -> dict[str, dict[int, int]]:
    """source -> bucket -> tokens, over all rows or those in the boundary buckets (source, coarser bucket)."""
    rows = sizes
    if boundary is not None:
        spark = sizes.sparkSession
        edge = spark.createDataFrame(sorted(boundary), "source string, coarse bigint")  # at most one per mix and source
        rows = sizes.withColumn("coarse", F.shiftright("h", shift + LEVELS[0])).join(F.broadcast(edge), ["source", "coarse"])
    hist: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("n")).collect():  # <= sources x 4096 x boundaries
        hist.setdefault(r.source, {})[r.b] = r.n
    return hist


def plan_mixes(sizes: DataFrame, targets: list, max_rows: int = 2000) -> list[Draw]:
    """Thresholds for every (mix, source). ``sizes``: source, h, tokens of all documents."""
    if len(targets) > max_rows:
        raise ValueError(f"more than {max_rows} mix targets")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = sorted({t.source for t in targets if t.source is not None})
    spark = sizes.sparkSession
    mine = sizes.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string")), "source", "left_semi")
    shift = sum(LEVELS[1:])
    hist = _histogram(mine, None, shift)
    weight: dict[str, float] = {}
    for t in targets:
        weight[t.mix_name] = weight.get(t.mix_name, 0.0) + max(t.target_share or 0.0, 0.0)
    draws = []
    for t in targets:
        share = max(t.target_share or 0.0, 0.0) / weight[t.mix_name] if weight[t.mix_name] else 0.0
        have = sum(hist.get(t.source, {}).values())
        d = Draw(t.mix_name, t.source, share, share * (t.size_ratio or 0.0) * total, have, t.max_repeats)
        if have:
            d.full = int(d.budget // have)
            d.rest = d.budget - d.full * have
            if d.cap is not None and d.full >= d.cap:
                d.full, d.rest = d.cap, 0.0
        draws.append(d)
    for level in range(len(LEVELS)):
        edge = set()
        for d in draws:
            if d.rest <= 0 or (level and d.threshold < 0):
                continue
            low = d.threshold >> shift if level else 0
            size = 1 << LEVELS[level]
            buckets = hist.get(d.source, {})
            b = low
            while b < low + size and d.below + buckets.get(b, 0) <= d.rest:
                d.below += buckets.get(b, 0)
                b += 1
            d.threshold = b << shift
            if b < low + size:
                edge.add((d.source, b))
        if level + 1 == len(LEVELS) or not edge:
            break
        shift -= LEVELS[level + 1]
        hist = _histogram(mine, edge, shift)
    return draws


def draw_mixes(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: str = "mix-1") -> tuple[DataFrame, DataFrame]:
    """(drawn, report).

    drawn: mix_name, doc_id, source, tokens, copies (>= 1). report, one row per mix and source:
    target_share (of the mix's sum), target_tokens, available_tokens, drawn_tokens, actual_share (of
    the mix's drawn tokens), max_copies, shortfall_tokens. A source is drawn up to its share of
    size_ratio x the corpus, never above, short by less than its next document; where the cap binds
    or the source is absent, the shortfall is reported and isn't given to others. A null cap allows
    any number of copies; a null or negative share counts as 0; documents without source or outside a
    mix's sources aren't drawn; empty texts weigh 0 and follow the threshold. Token sizes are counted
    once and written to the shared folder.
    """
    base = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("__t")))
    sizes = base.select("doc_id", "source", mix_hash(F.col("doc_id"), seed).alias("h"), token_count_udf(tokenizer)(F.coalesce("__t", F.lit(""))).alias("tokens"))
    sizes = materialise(sizes, "mix-sizes")
    rows = targets.select("mix_name", "source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"), F.col("size_ratio").cast("double").alias("size_ratio")).limit(2001).collect()
    draws = plan_mixes(sizes, rows)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(d.mix, d.source, d.share, d.budget, d.available, d.full, d.threshold) for d in draws],
        "mix_name string, source string, target_share double, target_tokens double, available_tokens bigint, full bigint, threshold bigint",
    )
    drawn = sizes.join(F.broadcast(plan), "source").withColumn("copies", F.col("full") + (F.col("h") < F.col("threshold")).cast("bigint")).filter("copies > 0")
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("max_copies"))
    report = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["drawn_tokens", "max_copies"])
    mixed = got.groupBy("mix_name").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    report = report.join(mixed, "mix_name", "left").select(
        "mix_name", "source", "target_share", "target_tokens", "available_tokens", "drawn_tokens",
        F.coalesce(F.try_divide("drawn_tokens", "mix_tokens"), F.lit(0.0)).alias("actual_share"), "max_copies",
        (F.col("target_tokens") - F.col("drawn_tokens")).alias("shortfall_tokens"),
    )
    return drawn.select("mix_name", "doc_id", "source", "tokens", "copies"), report
