"""Shapes of rows: identities with provenance, feature blocks, versions, eligibility, recodes, ratios.

Everything takes column names; groups are reduced before they are joined, and joins are on equal keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import hash_unit, norm_key, quantile


def first_source(sources: dict[str, Column], missing: str = "missing") -> tuple[Column, Column]:
    """(value, name of its source): the first source that has a value."""
    name = reduce(lambda acc, kv: acc.when(kv[1].isNotNull(), kv[0]) if acc is not None else F.when(kv[1].isNotNull(), kv[0]), sources.items(), None)
    return F.coalesce(*sources.values()), name.otherwise(missing)


def outer_features(blocks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of feature blocks with one row per key each (an error otherwise); what a block doesn't
    have stays null. Null keys don't meet."""
    for b in blocks:
        if b.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"a block repeats a key of {keys}")
    return reduce(lambda a, b: a.join(b, keys, "full"), blocks)


def expansion_audit(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_items after a join and ``expansion``: the rows it added (below 0: lost)."""
    b, a = before.groupBy(*keys).agg(F.count("*").alias("__b")), after.groupBy(*keys).agg(F.count("*").alias("n_items"))
    return a.join(b, keys).select(*keys, "n_items", (F.col("n_items") - F.col("__b")).alias("expansion"))


def latest_event(rows: DataFrame, events: DataFrame, keys: list[str], date: str, counted: str, when: Column) -> DataFrame:
    """``rows`` with n_events (distinct ``counted``), last_event and late_event: an event after ``when``. Events
    are reduced to one row per key first; keys without events have 0, null and false."""
    ev = events.groupBy(*keys).agg(F.count_distinct(counted).alias("n_events"), F.max(date).alias("last_event"))
    j = rows.join(ev, keys, "left")
    return j.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint"))).withColumn("late_event", F.coalesce(F.col("last_event") > when, F.lit(False)))


def paired(first: DataFrame, second: DataFrame, keys: list[str], same: list[str], value: str) -> DataFrame:
    """Rows of two receipts side by side: ``keys``, ``same``, ``value``_1 and ``value``_2. The receipts must hold
    the same keys, and equal ``same`` for each; anything else is an error."""
    b = second.select(*keys, *[F.col(c).alias(f"__{c}") for c in same], F.col(value).alias(f"{value}_2"), F.lit(True).alias("__right"))
    j = first.withColumn("__left", F.lit(True)).join(b, keys, "full")
    torn = F.col("__left").isNull() | F.col("__right").isNull()
    for c in same:
        torn = torn | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if j.filter(torn).limit(1).count():
        raise ValueError("the receipts aren't of the same rows")
    return j.select(*keys, *same, F.col(value).alias(f"{value}_1"), f"{value}_2")


def group_market(groups: DataFrame, rows: DataFrame, keys: list[str], price: str, key: str) -> DataFrame:
    """``groups`` with n, median, cheapest ``price`` and the ``key`` of the cheapest row (ties: the smallest) of
    the rows with a positive price; groups without one are left out."""
    per = rows.filter(F.col(price) > 0).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.percentile(price, 0.5), 6).alias("median"), F.min_by(key, F.struct(price, key)).alias("example"), F.min(price).alias("cheapest"))
    return groups.join(per, keys)


def keyed_by_any(df: DataFrame, spellings: list[Column], key: str) -> DataFrame:
    """``k``, ``key``: an index over several spellings, each once; null spellings are left out."""
    return df.select(F.explode(F.array_compact(F.array(*spellings))).alias("k"), key).distinct()


def first_of(df: DataFrame, same: Column, key: str) -> DataFrame:
    """h, ``key``: the smallest key of the rows that share ``same`` (DISTINCT ON); null ``same`` is left out."""
    return df.filter(same.isNotNull()).groupBy(same.alias("h")).agg(F.min(key).alias(key))


def version_states(df: DataFrame, key: str, family: list[str], payload: str) -> DataFrame:
    """``key``, families, versions, state: several_families, conflict (several payloads) or kept, by digests."""
    fam = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in family]), 256)
    v = df.groupBy(key).agg(F.count_distinct(fam).alias("families"), F.count_distinct(F.md5(payload)).alias("versions"))
    return v.select(key, "families", "versions", F.when(F.col("families") > 1, "several_families").when(F.col("versions") > 1, "conflict").otherwise("kept").alias("state"))


def supported_rows(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``df`` with ``eligible``: the group has ``least`` rows; null for rows with a null key."""
    c = df.dropna(subset=keys).groupBy(*keys).agg((F.count("*") >= least).alias("eligible"))
    return df.join(c, keys, "left")


def eligibility(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with a flag per rule (unknown counts as failed), ``failed`` (names, joined by ';') and ``eligible``."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    out = df.withColumns({f"{n}_ok": c for n, c in flags.items()})
    failed = F.concat_ws(";", *[F.when(~F.col(f"{n}_ok"), n) for n in rules])
    return out.withColumn("failed", failed).withColumn("eligible", F.col("failed") == "")


def merge_annotations(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``value``, conflict of two annotators; where they differ the value stays open."""
    j = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key, "full")
    clash = F.coalesce(F.col("__a") != F.col("__b"), F.lit(False))
    return j.select(key, F.when(~clash, F.coalesce("__a", "__b")).alias(value), clash.alias("conflict"))


def mapped_distinct(df: DataFrame, columns: list[str], mapping: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``mapping`` adds to its distinct ``columns``: an expensive mapping runs once per tuple and
    is joined back null-safe."""
    distinct = df.select(*columns).distinct()
    known = mapping(distinct)
    added = [c for c in known.columns if c not in columns]
    right = known.select(*[F.col(c).alias(f"__{c}") for c in columns], *added)
    return df.join(right, reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[f"__{c}"]) for c in columns])).drop(*[f"__{c}" for c in columns])


def unprotected(df: DataFrame, lists: dict[str, DataFrame], reserve_by: str | None = None, reserve: float = 0.0) -> DataFrame:
    """Rows whose key is in none of the protected ``lists`` (column -> one-column frame) and not reserved by its
    hash. Rows with a null key are left out, as nothing shows that they are free."""
    out = df.dropna(subset=[*lists, *([reserve_by] if reserve_by else [])])
    for column, ids in lists.items():
        out = out.join(ids.select(F.col(ids.columns[0]).alias(column)).dropna().distinct(), column, "left_anti")
    return out.filter(hash_unit(reserve_by) >= reserve) if reserve_by else out


def changed_attributes(frozen: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``changed`` (names, joined by ';'; 'gone' where the source has no such key) of frozen rows that
    aren't what their source says now."""
    b = current.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    j = frozen.select(key, *columns).join(b, key, "left")
    changed = F.when(F.col("__there").isNull(), "gone").otherwise(F.concat_ws(";", *[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in columns]))
    return j.select(key, changed.alias("changed")).filter("changed <> ''")


def cohort_reasons(df: DataFrame, cohort: list[str], medians: dict[str, Column], positive: Column, rules: dict[str, Callable[[dict[str, Column]], Column]], error: float = 0.0) -> DataFrame:
    """``df`` with ``reasons`` (joined by ';', '' for none) against medians of its cohort.

    ``medians``: name -> value, over the rows where ``positive`` holds; ``rules``: reason -> condition of those
    medians, unknown as false. See :func:`quantile` for ``error``.
    """
    g = df.filter(positive).groupBy(*cohort).agg(*[quantile(v, 0.5, error).alias(f"__{n}") for n, v in medians.items()])
    m = {n: F.col(f"__{n}") for n in medians}
    out = df.join(g, cohort, "left").withColumn("reasons", F.concat_ws(";", *[F.when(F.coalesce(rule(m), F.lit(False)), n) for n, rule in rules.items()]))
    return out.drop(*[f"__{n}" for n in medians])


def has_label(packed: Column, label: str, separator: str = ";") -> Column:
    """Is ``label`` one of the labels joined by ``separator``? Null labels: no."""
    return F.coalesce(F.array_contains(F.transform(F.split(packed, f"\\Q{separator}\\E"), lambda x: F.trim(x)), label), F.lit(False))


def typed_amount(text: Column) -> Column:
    """Whole amount as people type it: '18k', '$18,000', ' 7500 '. Anything else is null."""
    t = F.lower(F.trim(text))
    n = F.replace(F.regexp_extract(t, r"^\$?([0-9][0-9,]*\.?[0-9]*)k?$", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.round(n * F.when(t.endswith("k"), 1000).otherwise(1)).cast("bigint")


def range_presets(df: DataFrame, column: str, decades: tuple[int, ...] = (2, 3, 4, 5), steps: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5)) -> DataFrame:
    """preset: the round values (``steps`` times powers of ten; fixed values) within the column's range."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    grid = F.explode(F.array(*[F.lit(n * 10.0**i) for i in decades for n in steps]))
    return ends.select("lo", "hi", grid.alias("preset")).filter("preset BETWEEN lo AND hi").select("preset")


def recode(col: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    """Value of a dictionary; ``otherwise`` for null and unknown keys."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col) if table else F.lit(None).cast("string")
    return F.coalesce(known, F.lit(otherwise).cast("string"))


def catalog_key(col: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def dictionary_terms(text: Column, terms: list[str]) -> Column:
    """Terms, in the order given, that stand in a text as whole words; a longer term uses up its words, so that a term inside
    it counts only where it stands alone. Null texts give null."""
    t, found = F.lower(text), {}
    for term in sorted(terms, key=lambda x: (-len(x), x)):
        pattern = r"(?U)\b\Q" + term + r"\E\b"
        found[term] = F.when(t.rlike(pattern), term)
        t = F.regexp_replace(t, pattern, "\x01")
    return F.when(text.isNotNull(), F.array_compact(F.array(*[found[x] for x in terms])))


def number_before(text: Column, unit: str) -> Column:
    """The first number that is followed by ``unit`` (a pattern); null without one."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:" + unit + ")", 1).try_cast("double")


def torque_nm(text: Column) -> Column:
    """Newton metres of a torque text in lb-ft or Nm."""
    pounds = number_before(text, "lb-ft")
    return F.coalesce(F.round(pounds * 1.3558179483, 6), number_before(text, "Nm"))


def in_range(value: Column, low: float, high: float) -> tuple[Column, Column]:
    """(value or null where it is outside, is it missing?)."""
    ok = F.coalesce(value.between(low, high), F.lit(False))
    return F.when(ok, value), ~ok


def date_after(date: Column, days: Column, most: int = 10_000) -> Column:
    """Date plus days; null where the days aren't between 0 and ``most``."""
    return F.when(days.between(0, most), F.date_add(date, days.cast("int")))


def scope_label(flag: Column, yes: str = "new", no: str = "used", otherwise: str = "unknown") -> Column:
    n = F.lower(F.trim(flag))
    return F.when(n == "true", yes).when(n == "false", no).otherwise(otherwise)


def observed(columns: list[str]) -> Column:
    """How many of the columns have a value."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def option_flag(packed: Column, label: str) -> Column:
    """1 or 0: is ``label`` among the quoted labels of a bracketed list? Null where the field is no list."""
    return F.when(F.trim(packed).startswith("["), packed.rlike("['\"]\\Q" + label + "\\E['\"]").cast("int"))


def log_if(value: Column, ok: Column, digits: int = 6) -> Column:
    return F.when(ok, F.round(F.log1p(value), digits))


def array_mean(col: Column) -> Column:
    """Mean of the values of an array; null for an empty one."""
    return F.try_divide(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(col))


def dates_in_formats(raw: Column, formats: tuple[str, ...]) -> Column:
    """Date by the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats]).cast("date")


def group_weights(df: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """``df`` with 1 / (rows of its group), so that every group weighs 1. Null groups are left out."""
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    return df.join(n, group).withColumn(out, F.round(F.lit(1.0) / F.col("__n"), 12)).drop("__n")


def with_group_min(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """``df`` with the smallest ``column`` of its group: reduced first, then joined back."""
    return df.join(df.groupBy(group).agg(F.min(column).alias(out)), group)


def identity_key(*columns: str) -> Column:
    """Normalised columns joined by '|'; nulls count as empty."""
    return F.concat_ws("|", *[F.coalesce(norm_key(F.col(c)), F.lit("")) for c in columns])


def strata_sample(df: DataFrame, key: str, stratum: str, shares: dict[str, float], size: int, group: str, per_group: int, text: str, seed: str = "42") -> DataFrame:
    """``size`` rows with fixed shares of strata, at most ``per_group`` of a group and every text once.

    Texts keep their row of the smallest hash, groups their ``per_group`` smallest; strata then fill their
    share by hash. What a stratum lacks stays open: shares are reached or the sample is smaller.
    """
    from pyspark.sql import Window as W

    from ..functions.expr import sha_hex
    from .opinion import first_of_duplicates

    ranked = df.withColumn("__h", sha_hex(key, salt=seed)).withColumn("__t", F.md5(F.coalesce(text, F.lit(""))))
    once = first_of_duplicates(ranked, ["__t"], ["__h", key])
    kept = once.withColumn("__g", F.row_number().over(W.partitionBy(group).orderBy("__h", key))).filter(F.col("__g") <= per_group)
    parts = [kept.filter(F.col(stratum) == name).orderBy("__h", key).limit(int(size * share)) for name, share in shares.items()]
    return reduce(DataFrame.unionByName, parts).select(*df.columns)


def score_batches(df: DataFrame, columns: list[str], load: Callable[[], Callable], outputs: dict[str, T.DataType]) -> DataFrame:
    """``df`` with ``outputs`` of a model that Spark doesn't have: ``load`` returns a function of a pandas frame of
    ``columns`` and runs once per task; rows go through Arrow batches."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in outputs.items()]])

    def run(batches):
        model = load()
        for pdf in batches:
            yield pdf.assign(**dict(zip(outputs, model(pdf[columns]))))

    return df.mapInPandas(run, schema)
