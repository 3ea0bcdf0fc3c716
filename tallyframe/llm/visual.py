"""Visually identical text with different characters: one consistent form.

Compatibility decomposition, look-alike letters mapped to one letter, white space mapped, default
ignorable characters removed, canonical composition, and full case folding where wanted. Computed
once per distinct value; pure ASCII never leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise, spread

# Default ignorable code points.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Blanks of one character's width, besides those that compatibility mapping covers.
SPACES = [0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000, 0x00A0]
# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ѵ": "V",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin variants
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ǀ": "l",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V",
    "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# small capitals whose small letter has the same shape
LOOKALIKES |= {unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {c}"): c.lower() for c in "COUVWZ"} | {"ꜱ": "s"}
_STRIP = {c: None for lo, hi in IGNORABLE for c in range(lo, hi + 1)} | {c: " " for c in SPACES}
_LOOK = _STRIP | {ord(k): v for k, v in LOOKALIKES.items()}


def canonical(text: str, fold: bool = True, lookalikes: bool = True) -> str:
    """One form of a text. ``fold``: full case folding; ``lookalikes``: letters by their look.

    Line ends and tabs stay (they are layout, not kinds of blank), accents stay, digits stay apart.
    Idempotent.
    """
    if text.isascii():
        return text.lower() if fold else text
    t = unicodedata.normalize("NFKD", text).translate(_LOOK if lookalikes else _STRIP)
    t = unicodedata.normalize("NFC", t)
    if fold:
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t.casefold()).translate(_LOOK if lookalikes else _STRIP).casefold())
    return t


def canonical_udf(fold: bool = True, lookalikes: bool = True):
    """Arrow UDF of :func:`canonical`, evaluated per distinct value of a batch; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            forms = [canonical(v, fold, lookalikes) for v in values] + [None]
            yield pd.Series([forms[c] for c in codes], dtype=object)

    return run


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def visual_form(text: Column, fold: bool = True, lookalikes: bool = True) -> Column:
    """Canonical form as a column. ASCII rows are mapped in the JVM, only the others go to Python."""
    plain = F.lower(text) if fold else text
    return F.when(is_ascii(text), plain).otherwise(canonical_udf(fold, lookalikes)(F.when(~is_ascii(text), text)))


def normalise(df: DataFrame, keys: list[str], text: str, out: str = "text_form", fold: bool = True, lookalikes: bool = True) -> DataFrame:
    """``keys`` and the consistent form of ``text``. Null stays null, empty stays empty, rows repeat
    as they came; a key named like ``out`` is an error."""
    if out in keys:
        raise ValueError(f"a key is named {out!r}")
    return spread(df.select(*keys, F.col(text).alias("__text"))).select(*keys, visual_form(F.col("__text"), fold, lookalikes).alias(out))


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row with non-empty text: key, look (digest of the case-folded form and of the look with
    its case), exact (digest of the text)."""
    base = spread(df.select(F.col(key).alias("id"), F.col(text).alias("__t")).filter(F.col("__t") != ""))

    @F.pandas_udf("fold string, look string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:32]
        for s in batches:
            codes, values = pd.factorize(s)
            both = [(digest(canonical(v)), digest(canonical(v, fold=False))) for v in values] + [(None, None)]
            yield pd.DataFrame([both[c] for c in codes], columns=["fold", "look"])

    py = base.withColumn("__f", forms(F.when(~is_ascii(F.col("__t")), F.col("__t"))))
    half = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    return py.select(
        "id",
        F.coalesce(F.unhex("__f.fold"), half(F.lower("__t"))).alias("fold"),
        F.coalesce(F.unhex("__f.look"), half(F.col("__t"))).alias("look"),
        half(F.col("__t")).alias("exact"),
    )


def lookalike_pairs(df: DataFrame, key: str, text: str, salts: int = 16) -> DataFrame:
    """doc_id_a < doc_id_b: rows whose texts look the same but differ in a character.

    Candidates share the case-folded form; the look with its case and the differing text are checked
    exactly. Classes with one text drop out after one aggregation. The rest expands class by class:
    pairs of different texts first, then their rows, salted by row so that a text with very many
    copies is spread over tasks. Empty and null texts and identical texts give no pair; a repeated key
    counts once. The digests (48 bytes a row) are written to the shared folder once, so no text is read
    or normalised again.
    """
    rows = materialise(look_classes(df, key, text), "looks")
    texts = rows.select("fold", "look", "exact").distinct()
    several = texts.groupBy("fold", "look").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("fold", "look")
    kinds = texts.join(several, ["fold", "look"])
    a, b = kinds.select("fold", "look", F.col("exact").alias("xa")), kinds.select("fold", "look", F.col("exact").alias("xb"))
    pairs = a.join(b, ["fold", "look"]).filter("xa < xb").select("look", "xa", "xb")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts).cast("bigint")))
    spread_pairs = pairs.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    left = salted.select("look", F.col("exact").alias("xa"), "salt", F.col("id").alias("ia")).join(spread_pairs, ["look", "xa", "salt"]).select("look", "xb", "ia")
    again = left.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    both = again.join(salted.select("look", F.col("exact").alias("xb"), "salt", F.col("id").alias("ib")), ["look", "xb", "salt"])
    return both.filter("ia <> ib").select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()


def lookalike_classes(df: DataFrame, key: str, text: str, hot: int = 1000) -> DataFrame:
    """One row per row with non-empty text: ``key``, class_id (the smallest key of the texts that look the
    same), links (rows of the class with another text) and copies (other rows with the same text).

    Rows are counted per text before classes are formed, so a class is an aggregation of its different
    texts, however many rows it has. Texts with more than 1 / ``hot`` of the rows are fewer than ``hot``
    and meet their rows by a broadcast; of the others none has more rows than that in one task. Empty and
    null texts have no row; a repeated key gives its rows again.
    """
    rows = materialise(look_classes(df, key, text), "looks")
    by = ["fold", "look", "exact"]
    texts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("fold", "look").agg(F.min("least").alias("class_id"), F.sum("n").alias("rows"))
    info = texts.join(classes, ["fold", "look"]).select(*by, "class_id", (F.col("rows") - F.col("n")).alias("links"), (F.col("n") - 1).alias("copies"))
    info = materialise(info, "classes")
    bound = rows.count() // hot
    large = F.broadcast(info.filter(F.col("copies") > bound))
    out = rows.join(large, by).unionByName(rows.join(large.select(*by), by, "left_anti").join(info.filter(F.col("copies") <= bound), by))
    return out.select(F.col("id").alias(key), "class_id", "links", "copies")
