"""Several values packed in one field: one row per value, with its place kept.

Quoted spans are swapped for indexed placeholders, the rest is split on the delimiters, the spans
come back by array lookup and the array is exploded with positions. All JVM expressions: the only
stage is the scan, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let

DELIMITERS = ",;|\\t\\r\\n•‣◦▪·"  # commas, semicolons, bars, line ends, bullets
NO_LABEL = ("", "-", "--", "n/a", "na", "none", "null", "nan", "unknown")  # fixed values: fillers for a whole field
_OPEN, _CLOSE, _ESC = "", "", ""  # placeholder marks; the same characters in a text are escaped first


def _span_pattern(delims: str) -> str:
    """A quote that starts a label, up to the first like quote that ends one."""
    before = rf"(?<=^|[{delims}\[\{{(])(?:\s*+)"
    after = rf"(?=\s*(?:[{delims}\]\}})]|$))"
    body = r"(?:\\.|[^\\])*?"
    return f'{before}(?:"{body}"|\'{body}\'){after}'


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit(_ESC), F.lit(_ESC + "2"))
    out = F.replace(out, F.lit(_OPEN), F.lit(_ESC + "0"))
    return F.replace(out, F.lit(_CLOSE), F.lit(_ESC + "1"))


def _unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(_ESC + "0"), F.lit(_OPEN))
    out = F.replace(out, F.lit(_ESC + "1"), F.lit(_CLOSE))
    return F.replace(out, F.lit(_ESC + "2"), F.lit(_ESC))


def _unquote(span: Column) -> Column:
    """Text inside a quoted span. Double quotes follow JSON escapes where they are valid JSON,
    otherwise doubled and backslashed quotes stand for themselves."""
    inner = span.substr(F.lit(2), F.length(span) - 2)
    plain = F.regexp_replace(F.regexp_replace(inner, r"\\(.)", "$1"), '""', '"')
    as_json = F.get_json_object(F.concat(F.lit('{"v":'), span, F.lit("}")), "$.v")
    return F.when(span.startswith('"'), F.coalesce(as_json, plain)).otherwise(plain)


def packed_labels(text: Column, delimiters: str = DELIMITERS) -> Column:
    """array<string> of the labels in ``text``, in order, empty places skipped.

    Null, blank and filler fields give an empty array. Delimiters inside a quoted label belong to
    it; a quote counts only where it opens a label and closes before a delimiter, so inch marks and
    apostrophes stay. Surrounding list brackets are packing and dropped.
    """
    pattern = _span_pattern(delimiters)
    marked = rf"^{_OPEN}(\d+){_CLOSE}$"

    def packed(body: Column) -> Column:
        open_list = body.rlike(r"(?s)^\[.*\]$|^\{.*\}$|^\(\s*['\"].*\)$")
        return let(F.when(open_list, body.substr(F.lit(2), F.length(body) - 2)).otherwise(body), split_up)

    def split_up(body: Column) -> Column:
        quoted = body.contains('"') | body.contains("'")
        return F.when(quoted, let(F.split(body, pattern, -1), lambda pieces: with_spans(body, pieces))).otherwise(to_labels(body, None))

    def with_spans(body: Column, pieces: Column) -> Column:
        last = F.size(pieces) - 1
        masked = F.array_join(F.transform(pieces, lambda p, i: F.when(i < last, F.concat(p, F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))).otherwise(p)), "")
        return let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda spans: to_labels(masked, spans))

    def to_labels(masked: Column, spans: Column | None) -> Column:
        def restore(tok: Column) -> Column:
            t = F.regexp_replace(tok, r"^\s+|\s+$|^\s*[-*–]\s+", "")
            if spans is None:
                return _unescape(t)
            span = let(t, lambda x: let(F.regexp_extract(x, marked, 1), lambda at: F.when(at != "", let(F.regexp_replace(F.get(spans, at.cast("int")), r"^\s+", ""), _unquote)).otherwise(x)))
            return F.regexp_replace(_unescape(span), r"^\s+|\s+$", "")

        return F.filter(F.transform(F.split(masked, f"[{delimiters}]", -1), restore), lambda t: t != "")

    missing = text.isNull() | F.lower(F.trim(text)).isin(*NO_LABEL)
    return F.when(missing, F.array().cast("array<string>")).otherwise(let(F.regexp_replace(_escape(text), r"^[\s\x{FEFF}]+|\s+$", ""), packed))


def explode_packed(df: DataFrame, keys: list[str], column: str, pos_col: str = "pos", label_col: str = "label", delimiters: str = DELIMITERS) -> DataFrame:
    """One row per label of ``column``: the ``keys``, ``pos_col`` (bigint, from 1) and ``label_col``.

    Nulls, blanks, fillers and fields holding only delimiters or empty quotes give no row; repeated
    labels and repeated input rows are all kept. Other input columns are dropped first, so their
    names can't clash; a key named like a result column is an error.
    """
    clash = {pos_col, label_col} & set(keys)
    if clash:
        raise ValueError(f"keys clash with result columns: {sorted(clash)}")
    base = df.select(*keys, F.col(column).alias("__packed"))
    base = base.filter(F.col("__packed").isNotNull()).select(*keys, F.posexplode(packed_labels(F.col("__packed"))).alias("__p", label_col))
    return base.select(*keys, (F.col("__p") + 1).cast("bigint").alias(pos_col), label_col)
