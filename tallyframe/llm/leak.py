"""Evaluation passages inside training text.

Item-sized windows of words are embedded by the CGK random walk, which turns edit distance into
Hamming distance; repeated bit sampling of the embeddings gives LSH keys that near windows share
with the recall wanted; documents and items meet in a join on the keys, and candidates are verified
by exact edit distance.

Neither side is held whole: the items' keys and the documents' keys are tables. What is broadcast is
one bit table of the items' runs of words of a size fixed by a parameter; it decides which places of
a document are embedded at all, which loses nothing (see :func:`gram_rule`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .visual import canonical

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
WALK = 3  # steps of the walk per word of the window


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the consistent form (see ``visual``), case folded."""
    return _WORD.findall(canonical(text)) if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), dtype=np.uint64, count=len(ws))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Embedding:
    """``repeats`` CGK walks over windows of ``window`` words, each with ``samples`` sampled places.

    Step j writes the current word and moves on by one random bit of (word, j); past the end a pad is
    written. A repeat's key hashes its sampled places.
    """

    def __init__(self, window: int, repeats: int, samples: int, seed: int = 11):
        self.window, self.repeats = window, repeats
        rng = np.random.default_rng(seed)
        steps = WALK * window
        self.seeds = rng.integers(1, 2**63, size=(repeats, steps), dtype=np.uint64)
        self.places = [np.sort(rng.choice(steps, size=min(samples, steps), replace=False)) for _ in range(repeats)]

    def keys(self, hashes: np.ndarray, starts: np.ndarray, length: int | None = None) -> Iterator[np.ndarray]:
        """Keys (uint64) of the windows of ``length`` words (else ``window``) that begin at ``starts``, one
        array per repeat."""
        length = length or self.window
        for r in range(self.repeats):
            at = np.zeros(len(starts), dtype=np.int64)
            key = np.full(len(starts), r + 1, dtype=np.uint64)
            wanted, last = set(self.places[r].tolist()), int(self.places[r][-1])
            for j in range(last + 1):
                inside = at < length
                symbol = np.where(inside, hashes[np.minimum(starts + at, len(hashes) - 1)], np.uint64(0))
                if j in wanted:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + symbol)
                at += (_mix(symbol ^ self.seeds[r][j]) & np.uint64(1)).astype(np.int64) * inside
            yield key


@lru_cache(maxsize=64)
def repeats_for(recall: float, edits: int, window: int, samples: int, trials: int = 1500) -> int:
    """Repeats with which, of ``trials`` seeded random windows with ``edits`` random edits, half of the
    chance to miss that ``recall`` leaves isn't used up, for changed, missing and added words each."""
    if edits == 0:
        return 1
    return max(_repeats(recall, edits, window, samples, trials, kind) for kind in ("changed", "missing", "added"))


def _edited(plain: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Windows with so many words changed, missing or added at random places."""
    out = plain
    for _ in range(edits):
        trials, n = out.shape
        place = rng.integers(0, n, trials)[:, None]
        new = rng.integers(1, 2**62, (trials, 1)).astype(np.uint64)
        grid = np.arange(n + 1 if kind == "added" else n)
        if kind == "changed":
            out = np.where(grid == place, new, out)
        elif kind == "missing" and n > 1:
            out = out[grid != place].reshape(trials, n - 1)
        elif kind == "added":
            moved = np.minimum(grid - (grid > place), n - 1)
            out = np.where(grid == place, new, np.take_along_axis(out, moved, 1))
    return out


def _repeats(recall: float, edits: int, window: int, samples: int, trials: int, kind: str) -> int:
    rng = np.random.default_rng(7)
    plain = rng.integers(1, 2**62, (trials, window)).astype(np.uint64)
    other = _edited(plain, edits, kind, rng)
    missed, emb = np.ones(trials, bool), Embedding(window, 256, samples)
    n = other.shape[1]
    pairs = zip(emb.keys(plain.ravel(), np.arange(trials) * window, window), emb.keys(other.ravel(), np.arange(trials) * n, n))
    for r, (a, b) in enumerate(pairs, 1):
        missed &= a != b
        if missed.mean() <= (1 - recall) / 2:
            return r
    return emb.repeats


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Word-level Levenshtein distance, ``limit`` + 1 if greater."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        cur = [i]
        for j, y in enumerate(b.tolist(), 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        if min(cur) > limit:
            return limit + 1
        prev = cur
    return min(prev[-1], limit + 1)


#: A window as a table row: its words as hashes.
_ITEM_KEYS = "item_id bigint, other binary, keys array<bigint>"
_DOC_KEYS = "doc_id bigint, at bigint, words binary, keys array<bigint>"


def gram_rule(window: int, edits: int) -> tuple[int, int]:
    """(q, least): a window of ``window`` words or more within ``edits`` edits of another shares at least
    ``least`` of its runs of q words with it, as each edit touches q of them at most."""
    for q in (4, 3, 2, 1):
        least = window - q + 1 - q * edits
        if least >= max(1, window // 4) or q == 1:
            return q, max(least, 0)
    raise AssertionError


def gram_hashes(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of the run of q words at each place of ``h``."""
    out = np.full(max(0, len(h) - q + 1), q, dtype=np.uint64)
    for i in range(q):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


@dataclass(frozen=True)
class Plan:
    """How windows are formed: passages of ``window`` words, or whole items of ``shortest`` words and more
    that are shorter than that; within ``edits`` word edits; ``embeddings`` by length."""

    window: int
    shortest: int
    edits: int
    bits: int
    embeddings: dict[int, Embedding]

    def starts(self, n: int) -> tuple[int, range]:
        """(length, starts) of the windows of an item of n words."""
        length = min(n, self.window)
        return length, range(n - length + 1) if length >= self.shortest else range(0)


def make_plan(window: int, max_edits: int, recall: float, samples: int, shortest: int | None, bits: int) -> Plan:
    shortest = window if shortest is None else shortest
    return Plan(window, shortest, max_edits, bits, {n: Embedding(n, repeats_for(recall, max_edits, n, samples), samples) for n in range(shortest, window + 1)})


def _item_rows(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["k"], pdf["t"]):
                h = word_hashes(words(text))
                length, at = plan.starts(len(h))
                if not at:
                    continue
                held = [h[i : i + length].tobytes() for i in at]
                keys = np.array(list(plan.embeddings[length].keys(h, np.arange(len(at)), length)))
                yield pd.DataFrame({"item_id": np.full(len(at), item, np.int64), "other": held, "keys": list(keys.T.view(np.int64))})

    return run


def _gram_bits(plan: Plan):
    """Bit places, by length of the windows, of the runs of words of the items in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["t"]:
                h = word_hashes(words(text))
                length, at = plan.starts(len(h))
                if at:
                    places = np.unique(_places(plan, h, length))
                    yield pd.DataFrame({"length": np.full(len(places), length, np.int32), "place": places})

    return run


def _places(plan: Plan, h: np.ndarray, length: int) -> np.ndarray:
    grams = _mix(gram_hashes(h, gram_rule(length, plan.edits)[0]) + np.uint64(length))
    return (grams >> np.uint64(64 - plan.bits)).astype(np.int64)


def _doc_rows(plan: Plan, shared):
    """Keys of the windows of documents that may be near an item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not plan.embeddings:
            return
        table = np.unpackbits(np.frombuffer(zlib.decompress(shared.value), np.uint8)).view(bool)
        for pdf in batches:
            per_doc = [word_hashes(words(t)) for t in pdf["t"]]
            if not per_doc:
                continue
            sizes = np.fromiter((len(x) for x in per_doc), np.int64, len(per_doc))
            stops = np.cumsum(sizes)
            h = np.concatenate(per_doc)
            ends, ids = np.repeat(stops, sizes), np.repeat(pdf["d"].to_numpy(np.int64), sizes)
            first = np.repeat(stops - sizes, sizes)
            for length, embedding in plan.embeddings.items():
                q, _ = gram_rule(length, plan.edits)
                if len(h) < q:
                    continue
                known = np.concatenate([[0], np.cumsum(table[_places(plan, h, length)])])
                for n in range(max(1, length - plan.edits), length + plan.edits + 1):
                    least = max(n, length) - q + 1 - q * plan.edits
                    starts = np.arange(len(h) - n + 1)
                    if n >= q and least > 0:
                        starts = starts[known[starts + n - q + 1] - known[starts] >= least]
                    starts = starts[starts + n <= ends[starts]]
                    if not len(starts):
                        continue
                    held = [h[s : s + n].tobytes() for s in starts.tolist()]
                    keys = np.array(list(embedding.keys(h, starts, n)))
                    yield pd.DataFrame({"doc_id": ids[starts], "at": starts - first[starts], "words": held, "keys": list(keys.T.view(np.int64))})

    return run


def edit_distances(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """:func:`edit_distance` of each row of ``a`` from the same row of ``b``, all rows at once and only in the
    band of cells that ``limit`` edits can reach."""
    n, m = a.shape[1], b.shape[1]
    far = limit + 1
    if abs(n - m) > limit:
        return np.full(len(a), far, np.int64)
    outside = np.full(len(a), far, np.int64)
    row = {j: np.full(len(a), j, np.int64) for j in range(min(m, limit) + 1)}
    for i in range(1, n + 1):
        new = {0: np.full(len(a), i, np.int64)} if i <= limit else {}
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            cell = row.get(j - 1, outside) + (a[:, i - 1] != b[:, j - 1])
            cell = np.minimum(cell, np.minimum(row.get(j, outside), new.get(j - 1, outside)) + 1)
            new[j] = np.minimum(cell, far)
        row = new
    return row[m]


def _verified(limit: int):
    """Candidates with their distance, where it is within ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = (pdf["words"].map(len) * 1_000_000 + pdf["other"].map(len)).to_numpy(np.int64)
            for size in np.unique(sizes):
                part = pdf[sizes == size]
                both = [np.frombuffer(b"".join(part[c]), np.uint64).reshape(len(part), -1) for c in ("words", "other")]
                found = part[["doc_id", "item_id", "at"]].assign(edits=edit_distances(*both, limit))
                yield found[found["edits"] <= limit].drop_duplicates()

    return run


def _may_be_near(edits: int) -> Column:
    """Necessary for windows ``words`` and ``other`` to be within ``edits`` edits, in the JVM: none leaves all
    words, one leaves either the words before it or those after it, which are half of them."""
    if edits == 0:
        return F.col("words") == F.col("other")
    if edits > 1:
        return F.lit(True)
    half = F.expr("8 * ((greatest(octet_length(words), octet_length(other)) DIV 8 - 1) DIV 2)").cast("int")
    ends = lambda c: F.substring(F.col(c), F.octet_length(c) - half + 1, half)
    starts = lambda c: F.substring(F.col(c), F.lit(1), half)
    return (starts("words") == starts("other")) | (ends("words") == ends("other"))


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 12, max_edits: int = 0, recall: float = 0.95, samples: int = 10, shortest: int | None = None, max_bits: int = 28, salts: int = 8, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, item_id, windows, min_edits, first_word: documents with a passage within ``max_edits`` word
    edits (changed, added or missing words) of a window of the item. An item's windows are its runs of
    ``window`` words; an item of fewer words, but at least ``shortest``, is a window as a whole (not by
    default). ``windows`` counts the different places of the document, ``first_word`` is the first with
    the fewest edits.

    ``max_edits`` = 0 finds every such document, and so does any setting for passages without an edit
    (equal windows always share all keys); above it, near windows are found with at least about
    ``recall``. All windows of whole texts are compared, in one pass over the documents.

    Items give a table of keys, one row per window and repeat, and a bit table of their runs of words
    with at least 8 places per run, up to 2 ** ``max_bits`` places (32 MB), which is put together from
    distinct places and broadcast. Documents give keys only where enough of their runs are in it: a
    fuller table lets more through and never loses a window. Both are joined on the key: item keys of up
    to ``broadcast_rows`` rows (counted; about 200 bytes each) are broadcast, more are shuffled, with the
    documents spread over ``salts``, so that a window that many documents share isn't one task. Null and
    empty texts and shorter items give no row; a repeated doc_id gives one row per item.
    """
    spark = docs.sparkSession
    base_items = items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL AND t <> ''")
    size = base_items.agg(F.sum(F.length("t"))).first()[0] or 0  # a run of words ends at a character of its own
    plan = make_plan(window, max_edits, recall, samples, shortest, min(max_bits, max(12, size.bit_length() + 3)))
    places = base_items.select("t").mapInPandas(_gram_bits(plan), "length int, place bigint").groupBy("length", "place").agg(F.count("*").alias("n"))
    word = F.expr("bit_or(shiftleft(1L, 31 - CAST(place & 31 AS INT)))")
    table, grams, lengths = np.zeros(1 << (plan.bits - 5), ">u4"), 0, set()
    for r in places.groupBy("length", F.shiftright("place", 5).alias("at")).agg(word.alias("bits"), F.sum("n").alias("n")).collect():  # at most 2 ** (bits - 5) rows a length
        table[r.at] |= r.bits
        grams += r.n
        lengths.add(r.length)
    plan = replace(plan, embeddings={n: e for n, e in plan.embeddings.items() if n in lengths})
    shared = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
    rows = grams * max((e.repeats for e in plan.embeddings.values()), default=1)  # an item has no more windows than runs of words
    base = spread(docs.select(F.col(doc_key).cast("bigint").alias("d"), F.col(doc_text).alias("t")).filter("d IS NOT NULL AND t IS NOT NULL AND t <> ''"))
    found = base.mapInPandas(_doc_rows(plan, shared), _DOC_KEYS).withColumn("key", F.explode("keys")).drop("keys")
    keyed = base_items.mapInPandas(_item_rows(plan), _ITEM_KEYS).withColumn("key", F.explode("keys")).drop("keys").distinct()
    if rows <= broadcast_rows:
        pairs = found.join(F.broadcast(keyed), "key")
    else:
        salted = keyed.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))).hint("merge")
        pairs = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(salts).cast("bigint"))).join(salted, ["key", "salt"])
    near = pairs.filter(_may_be_near(max_edits)).select("doc_id", "item_id", "at", "words", "other").mapInPandas(_verified(max_edits), "doc_id bigint, item_id bigint, at bigint, edits bigint")
    per_place = near.groupBy("doc_id", "item_id", "at").agg(F.min("edits").alias("edits"))
    out = per_place.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.min(F.struct("edits", "at")).alias("m"))
    return out.select("doc_id", "item_id", "windows", F.col("m.edits").alias("min_edits"), F.col("m.at").alias("first_word"))
