"""Texts: hashes, prefilters, segmentation with offsets, rule labels, calibrated decisions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import let


def word_hash(text: Column) -> Column:
    """SHA-256 of the words in lower case; punctuation and spacing don't count."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), 256)


@F.pandas_udf(T.StringType())
def folded_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of the compatibility-composed, case-folded text; punctuation counts."""
    import hashlib

    return text.map(lambda t: None if t is None else hashlib.sha256(unicodedata.normalize("NFKC", t).casefold().encode("utf-8", "surrogatepass")).hexdigest())


def prefilter_reason(text: Column, filler: tuple[str, ...] = ("lol", "ok", "nice", "first", "thanks")) -> Column:
    t = F.lower(F.trim(text))
    return F.when(text.isNull() | (t == ""), "empty").when(t.rlike(r"^https?://\S+$"), "url_only").when(t.isin(*filler), "filler").when(~t.rlike("[a-z]"), "no_letters")


def ascii_status(text: Column) -> Column:
    """latin, mixed or other, by the share of ASCII characters; null texts are unknown."""
    share = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text)
    return F.when(text.isNull() | (F.length(text) == 0), "unknown").when(share >= 0.9, "latin").when(share >= 0.5, "mixed").otherwise("other")


_CLAUSE = re.compile(r"[^.!?;\n]+(?:[.!?;]+|\n|$)")


def clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, clause_no, start, end, clause: clauses with their offsets; blank ones are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                no = 0
                for m in _CLAUSE.finditer(t):
                    c = m.group().strip()
                    if c:
                        no += 1
                        at = m.start() + len(m.group()) - len(m.group().lstrip())
                        rows.append((k, no, at, at + len(c), c))
            yield pd.DataFrame(rows, columns=["k", "clause_no", "start", "end", "clause"])

    base = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    return base.mapInPandas(run, f"k {kind}, clause_no bigint, start bigint, `end` bigint, clause string").withColumnRenamed("k", key)


_NEGATION = r"no|not|never|without"  # fixed values
_SUPPOSED = r"could|may|might|would|will|risk of|worried about"  # fixed values


def rule_labels(text: Column, rules: dict[str, str], supposed: bool = False, always: tuple[str, ...] = (), reach: int = 45) -> Column:
    """Sorted labels of the rules (patterns over lower-case text) with a match that nothing before it takes back.

    What is before a match counts up to ``reach`` characters and to the start of its sentence: a
    negation at most three words ahead, or, with ``supposed``, any word of supposition. Labels in
    ``always`` are given for every match. Null texts give null. Each rule marks its matches and folds over
    the pieces between them, in the JVM.
    """
    stop = r"(?U)\b(?:" + _NEGATION + r")\b(?:[^\w.;!?]+\w+){0,3}[^\w.;!?]*$"
    if supposed:
        stop += r"|\b(?:" + _SUPPOSED + r")\b[^.;!?]*$"

    def free(t: Column, pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(t, f"(?U)(?:{pattern})", "\x01$0"), "\x01")
        tail = lambda x: F.substring(x, -reach, reach)
        start = F.struct(tail(F.get(pieces, 0)).alias("before"), F.lit(False).alias("hit"))
        step = lambda acc, piece: F.struct(tail(F.concat(acc["before"], piece)).alias("before"), (acc["hit"] | ~acc["before"].rlike(stop)).alias("hit"))
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["hit"])

    def labels(t: Column) -> Column:
        found = [F.when(t.rlike(f"(?U)(?:{p})") if name in always else free(t, p), name) for name, p in sorted(rules.items())]
        return F.array_compact(F.array(*found))

    return F.when(text.isNotNull(), let(F.lower(F.replace(text, F.lit("\x01"), F.lit(" "))), labels))


def calibrated(scores: list[Column], temperature: float = 1.0) -> tuple[list[Column], Column, Column]:
    """Softmax probabilities, normalised entropy and margin of the best two."""
    top = F.greatest(*scores)
    ex = [F.exp((s - top) / temperature) for s in scores]
    total = ex[0]
    for e in ex[1:]:
        total = total + e
    probs = [e / total for e in ex]
    entropy = None
    for p in probs:
        term = -F.when(p > 0, p * F.ln(p)).otherwise(0.0)
        entropy = term if entropy is None else entropy + term
    order = F.sort_array(F.array(*probs), asc=False)
    return probs, entropy / F.ln(F.lit(float(len(scores)))), F.get(order, 0) - F.get(order, 1)


def choose_label(labels: list[str], probs: list[Column], margin: Column, least: float, least_margin: float, otherwise: str = "uncertain") -> Column:
    best = F.greatest(*probs)
    pick = None
    for name, p in zip(labels, probs):
        pick = F.when(p == best, name) if pick is None else pick.when(p == best, name)
    return F.when((best >= least) & (margin >= least_margin), pick).otherwise(otherwise)


def mask_for_model(text: Column, names: list[Column] = ()) -> Column:
    """Lower-case text with the row's own ``names`` (of three characters or more) as the word vehicle, and
    without phone numbers and the words that identify something: campaign numbers (two digits, V or E,
    six digits), years from 1900 to 2099, and vehicle numbers (11 to 17 letters and digits other than I,
    O and Q, with a digit). Null stays null."""
    t = F.lower(text)
    for name in names:
        n = F.lower(F.trim(name))
        literal = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(n, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_])"))
        t = F.when(F.length(n) >= 3, F.regexp_replace(t, literal, F.lit("vehicle"))).otherwise(t)
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(?:[0-9]{3}[ .-]){2}[0-9]{4}(?![\p{L}\p{N}_])", " ")

    def dropped(w: Column) -> Column:
        size = F.length(w)
        year = (size == 4) & w.rlike("^[0-9]+$") & w.try_cast("int").between(1900, 2099)
        campaign = (size == 9) & w.rlike("^[0-9]{2}[ve][0-9]+$")
        vehicle = size.between(11, 17) & w.rlike("[0-9]") & ~w.rlike("[^a-z0-9]|[ioq]")
        return year | campaign | vehicle

    words = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    kept = F.array_join(F.transform(words, lambda w: F.when(dropped(w), " ").otherwise(w)), "")
    return F.trim(F.regexp_replace(kept, r"[\s\u0085\p{Z}]+", " "))


def pooled_vectors(df: DataFrame, group: str, vector: str, digits: int = 9) -> DataFrame:
    """group, dim, value: mean vector per group, L2-normalised, in long form. Means are sums per
    (group, dimension), combined before the shuffle."""
    long = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = long.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    return long.join(norm, group).select(group, F.col("dim").cast("bigint").alias("dim"), F.round(F.try_divide("m", "l"), digits).alias("value"))
