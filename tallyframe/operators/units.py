"""Quantities recorded in different units: parse, link sources, snap scales, convert.

A value's own unit text counts first. Bare numbers take the unit of their source, found by a
source graph: sources are linked through the entities they share, each pair gets a robust scale
and offset, both are snapped to a known conversion, and units spread from the sources whose unit is
known: those whose note names one, and the values that name their own, which stand as one more source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..sources.shared import materialise

#: Common units (inches) in one unit of each length.
LENGTH_UNITS = {"in": 1.0, "ft": 12.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "m": 100 / 2.54}
#: Scale and offset to degrees Celsius.
TEMPERATURE_UNITS = {"C": (1.0, 0.0), "F": (5 / 9, -160 / 9), "K": (1.0, -273.15)}
STATED = "\0stated"  # the source of values that name their unit, in the common unit
MISSING_TEXT = ("", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "tbd", "not available")  # fixed values


def _clean(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"[\s    ]+", " "))
    t = F.regexp_replace(F.regexp_replace(t, "[′’‘´`]", "'"), "[″”“]|''", '"')
    return F.trim(t)


def length_unit(text: Column) -> Column:
    """Name of the length unit that a text names, or null. The longest names are looked for first."""
    t = F.lower(text)
    return (
        F.when(t.rlike(r"(?<![a-z])(cm|centi?m(et(er|re)s?)?|centimet(er|re)s?)(?![a-z])"), "cm")
        .when(t.rlike(r"(?<![a-z])(mm|millimet(er|re)s?)(?![a-z])"), "mm")
        .when(t.rlike(r"(?<![a-z])(ft|feet|foot)(?![a-z])"), "ft")
        .when(t.rlike(r"(?<![a-z])(m|mtrs?|met(er|re)s?)(?![a-z])"), "m")
        .when(t.rlike(r"(?<![a-z])(in|inch|inches)(?![a-z])"), "in")
    )


def _number(text: Column, grouped: Column) -> Column:
    """Decimal point or comma; a comma before three digits groups where ``grouped`` says so."""
    both = text.contains(",") & text.contains(".")
    last_comma = F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1))
    t = (
        F.when(both & last_comma, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(text, F.lit(","), F.lit("")))
        .when(text.rlike(r"^[+-]?\d{1,3}(,\d{3})+$") & grouped, F.replace(text, F.lit(","), F.lit("")))
        .otherwise(F.replace(text, F.lit(","), F.lit(".")))
    )
    return t.try_cast("double")


def parse_length(text: Column) -> Column:
    """struct(raw, unit, value, inches) of a written length.

    ``inches`` is set where the text names its unit (also feet with inches, and inch fractions);
    ``raw`` is the bare number's text where it names none. Missing or unreadable: null.
    """
    feet = r"^(\d+)\s*(?:'|ft\.?|feet|foot)\s*(\d+(?:[.,]\d+)?)\s*(?:\"|in\.?|inch(?:es)?)?$"
    frac = r"^(\d+)\s+(\d+)/(\d+)\s*(?:\"|in\.?|inch(?:es)?)$"
    plain = r"^([+-]?\d[\d.,]*)\s*(.*)$"
    factor = F.create_map(*[F.lit(x) for kv in LENGTH_UNITS.items() for x in kv])
    num = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")

    def result(raw, unit, value, inches) -> Column:
        return F.struct(raw.cast("string").alias("raw"), unit.cast("string").alias("unit"), value.alias("value"), inches.alias("inches"))

    nothing = F.lit(None)

    def plain_length(t: Column) -> Column:
        def with_rest(rest: Column) -> Column:
            unit = F.when(rest == '"', "in").when(rest == "'", "ft").otherwise(length_unit(rest))
            return let(unit, lambda u: let(F.regexp_extract(t, plain, 1), lambda n: F.when(rest == "", result(n, nothing, _number(n, F.lit(False)), nothing.cast("double"))).when(
                u.isNotNull() & rest.rlike("^([a-z]+|[\"'])$"), let(_number(n, u == "mm"), lambda v: result(nothing, u, v, v * F.try_element_at(factor, u))))))

        return let(F.trim(F.regexp_replace(F.regexp_extract(t, plain, 2), r"\.$", "")), with_rest)

    def parsed(t: Column) -> Column:
        ft_in = num(F.regexp_extract(t, feet, 1)) * 12 + num(F.regexp_extract(t, feet, 2))
        in_frac = num(F.regexp_extract(t, frac, 1)) + F.try_divide(num(F.regexp_extract(t, frac, 2)), num(F.regexp_extract(t, frac, 3)))
        return (
            F.when(t.isin(*MISSING_TEXT), None)
            .when(t.rlike(feet), let(ft_in, lambda v: result(nothing, F.lit("ft_in"), v, v)))
            .when(t.rlike(frac), let(in_frac, lambda v: result(nothing, F.lit("in"), v, v)))
            .when(t.rlike(plain), plain_length(t))
        )

    return let(_clean(text), parsed)


def money_unit(text: Column) -> Column:
    """Unit named in a text as ``CODE`` or ``CODE/100`` or ``CODE*1000``; null if it names none."""
    t = F.lower(text)
    code = (
        F.when(t.rlike(r"mxn|mex\$|mexic|\bpesos?\b"), "MXN")
        .when(t.rlike(r"\bcad\b|cdn|\bc\$|ca\$|canad"), "CAD")
        .when(t.rlike(r"€|\beur\b|\beuros?\b|\bkeur\b"), "EUR")
        .when(t.rlike(r"\$|usd|\busc\b|dollar|\bu\.?s\.? cents?\b|\bcents?\b"), "USD")
    )
    scale = F.when(t.rlike(r"\bcents?\b|\busc\b"), "/100").when(t.rlike(r"thousand|x ?1[,.]?000|\bk ?\$|\bk(usd|eur|cad)\b|\bk€|\$ ?k\b"), "*1000").otherwise("")
    return F.concat(code, scale)


def money_factor(unit: str, rates: dict[str, float]) -> float:
    code = unit[:3]
    return rates[code] * (0.01 if unit.endswith("/100") else 1000.0 if unit.endswith("*1000") else 1.0)


@dataclass
class Edge:
    """What the shared entities tell about two sources: the medians of both in the lower and the upper half
    of the entities (by a), the line through them and how far ratios lie from their median."""

    a: str
    b: str
    entities: int
    low: tuple[float, float]
    high: tuple[float, float]
    scale: float
    offset: float
    spread: float

    def turned(self) -> Edge:
        scale = 1 / self.scale if self.scale else float("inf")
        return Edge(self.b, self.a, self.entities, self.low[::-1], self.high[::-1], scale, -self.offset * scale, self.spread)

    def miss(self, unit_a: tuple[float, float], unit_b: tuple[float, float]) -> float:
        """How far the line that two units imply lies from the medians of b, relative to the smaller."""
        scale, offset = unit_a[0] / unit_b[0], (unit_a[1] - unit_b[1]) / unit_b[0]
        pairs = [(scale * x + offset, y) for x, y in (self.low, self.high)]
        return sum(abs(p - y) / max(1e-9, min(abs(p), abs(y))) for p, y in pairs) / len(pairs)


@dataclass
class UnitGraph:
    """``units`` of the sources and their ``factors``: scale and offset to the common unit. ``edges`` as
    estimated. ``conflicts``: sources whose stated unit isn't the one the estimates snap to."""

    factors: dict[str, tuple[float, float]]
    units: dict[str, str]
    edges: list[Edge] = field(default_factory=list)
    conflicts: dict[str, str] = field(default_factory=dict)


def source_medians(df: DataFrame, quantity: str, entity: list[str], source: str, value: str, accuracy: int = 2000) -> DataFrame:
    """One row per quantity, entity and source: the median of its values, from a mergeable sketch, so that a
    hot entity is combined before the shuffle. NaN and null values and null keys don't take part."""
    v = F.col(value).cast("double")
    ok = df.filter(v.isNotNull() & ~F.isnan(v) & F.col(source).isNotNull())
    for c in entity:
        ok = ok.filter(F.col(c).isNotNull())
    return ok.groupBy(F.col(quantity).alias("quantity"), *[F.col(c).alias(f"__e{i}") for i, c in enumerate(entity)], F.col(source).alias("source")).agg(F.percentile_approx(v, 0.5, accuracy).alias("median"))


def pair_lines(medians: DataFrame, accuracy: int = 2000) -> DataFrame:
    """One row per quantity and pair of sources (a < b) with shared entities: their number, a robust line of
    b over a, and the spread of the ratios.

    The line goes through the medians of both sources in the lower and in the upper half of the
    entities, which outliers hardly move; with fewer than two different values of a it goes through the
    origin. spread = median absolute deviation of ln(b / a), 0 where signs differ. The self-join is on
    the entity and holds one row per source.
    """
    keys = ["quantity", *[c for c in medians.columns if c.startswith("__e")]]
    a = medians.select(*keys, F.col("source").alias("a"), F.col("median").alias("va"))
    b = medians.select(*keys, F.col("source").alias("b"), F.col("median").alias("vb"))
    pair = ["quantity", "a", "b"]
    mid = lambda c, p=0.5: F.percentile_approx(c, p, accuracy)
    pairs = a.join(b, keys).filter(F.col("a") < F.col("b")).withColumn("l", F.ln(F.try_divide("vb", "va")))
    whole = pairs.groupBy(*pair).agg(mid("va").alias("ma"), mid("l").alias("ml"), F.count("*").alias("entities"))
    dev = pairs.join(whole, pair)
    low, high = F.col("va") <= F.col("ma"), F.col("va") >= F.col("ma")
    out = dev.groupBy(*pair).agg(
        F.first("entities").alias("entities"), mid(F.when(low, F.col("va"))).alias("a_low"), mid(F.when(low, F.col("vb"))).alias("b_low"),
        mid(F.when(high, F.col("va"))).alias("a_high"), mid(F.when(high, F.col("vb"))).alias("b_high"), F.coalesce(mid(F.abs(F.col("l") - F.col("ml"))), F.lit(0.0)).alias("spread"),
    )
    scale = F.when(F.col("a_high") > F.col("a_low"), (F.col("b_high") - F.col("b_low")) / (F.col("a_high") - F.col("a_low"))).otherwise(F.try_divide("b_high", "a_high"))
    return out.withColumn("scale", F.coalesce(scale, F.lit(0.0))).withColumn("offset", F.col("b_low") - F.col("scale") * F.col("a_low"))


def _affine(factor: float | tuple[float, float]) -> tuple[float, float]:
    return factor if isinstance(factor, tuple) else (factor, 0.0)


def solve_units(edges: list[Edge], sources: list[str], stated: dict[str, str], factors: dict[str, float | tuple[float, float]], default: str, prefer: float = 0.05) -> UnitGraph:
    """Spread units from the sources with a stated unit along the edges, best linked sources first.

    A source without a stated unit takes the known conversion whose line comes nearest to the estimated
    one at both ends of the shared entities, so scale and offset both decide; ``default`` if that comes
    within ``prefer`` of the nearest, or if nothing links the source. Neighbours vote by their entities
    and by how close and how tight the estimate is. A stated unit always holds; if the neighbours imply
    another, the source is listed in ``conflicts``.
    """
    known_units = {u: _affine(f) for u, f in factors.items()}
    near: dict[str, list[Edge]] = {s: [] for s in sources}
    for e in edges:
        near[e.a].append(e.turned())
        near[e.b].append(e)
    known = dict(stated)

    def implied(s: str) -> tuple[str, float] | None:
        votes: dict[str, float] = {}
        for e in near[s]:
            if e.a in known:
                miss = {u: e.miss(known_units[known[e.a]], f) for u, f in known_units.items()}
                best = min(miss, key=miss.get)
                if default in miss and miss[default] <= miss[best] + prefer:
                    best = default
                votes[best] = votes.get(best, 0) + e.entities / (0.01 + e.spread) / (0.02 + miss[best])
        return max(votes.items(), key=lambda v: v[1]) if votes else None

    graph = UnitGraph({}, {}, edges)
    for s in stated:
        others = implied(s) if s in near else None
        if others and others[0] != stated[s]:
            graph.conflicts[s] = others[0]
    pending = [s for s in sources if s not in known]
    while pending:
        ready = {s: found for s in pending if (found := implied(s))}
        if not ready:
            known |= {s: default for s in pending}
            break
        best = max(ready, key=lambda s: (ready[s][1], s))
        known[best] = ready[best][0]
        pending.remove(best)
    graph.units = known
    graph.factors = {s: known_units[u] for s, u in known.items()}
    return graph


def fit_source_units(df: DataFrame, quantity: str, entity: list[str], source: str, value: str, known: dict[str, tuple[dict, dict, str]], max_sources: int = 500) -> dict[str, UnitGraph]:
    """Graph of each quantity in one go. ``known``: quantity -> (stated units, factors, default). At most
    ``max_sources`` sources a quantity (an error beyond), so at most that many squared pairs reach the
    driver."""
    medians = materialise(source_medians(df, quantity, entity, source, value), "medians")
    rows = medians.select("quantity", "source").distinct().limit(max_sources * len(known) + 1).collect()
    if len(rows) > max_sources * len(known):
        raise ValueError(f"more than {max_sources} sources in {source!r}")
    edges: dict[str, list[Edge]] = {q: [] for q in known}
    for r in pair_lines(medians).collect():
        edges[r.quantity].append(Edge(r.a, r.b, r.entities, (r.a_low, r.b_low), (r.a_high, r.b_high), r.scale, r.offset, r.spread))
    out = {}
    for q, (stated, factors, default) in known.items():
        sources = sorted({r.source for r in rows if r.quantity == q})
        out[q] = solve_units(sorted(edges[q], key=lambda e: (e.a, e.b)), sources, stated, factors, default)
    return out


def _by_source(source: Column, values: dict[str, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(default))


def source_factor(source: Column, graph: UnitGraph, default: float) -> Column:
    """Column of each row's scale to the common unit; ``default`` for null or unknown sources."""
    return _by_source(source, {s: f[0] for s, f in graph.factors.items()}, default)


def to_common(value: Column, source: Column, graph: UnitGraph) -> Column:
    """A bare value in the common unit, by scale and offset of its source; unknown sources are in it."""
    return value * source_factor(source, graph, 1.0) + _by_source(source, {s: f[1] for s, f in graph.factors.items()}, 0.0)


def common_units(cars: DataFrame, notes: DataFrame, rates: DataFrame, entity: tuple[str, ...] = ("make_name", "model_name")) -> DataFrame:
    """Heights in inches and prices in US dollars for every listing.

    Returns row_id, height_in (double), height_recorded_in_inches, price_usd (double),
    price_recorded_in_usd. Missing or unreadable heights and null prices give nulls; repeated rows
    stay. The unit in the value, price_unit or description counts first, then the unit of the feed as its
    note or else the graph gives it. Values are parsed once and handed over. ``notes`` and ``rates`` are the fixed tables of feeds and currencies (collected; an error
    beyond 500 rows).
    """
    fx_rows = rates.select("currency", "usd_per_unit").limit(501).collect()
    note_rows = notes.select("feed", length_unit(F.col("note")).alias("l"), money_unit(F.col("note")).alias("m")).limit(501).collect()
    if len(fx_rows) > 500 or len(note_rows) > 500:
        raise ValueError("notes and rates must be small fixed tables")
    fx = {"USD": 1.0} | {r[0].strip().upper(): float(r[1]) for r in fx_rows if r[0] and r[1]}
    money = {f"{c}{s}": money_factor(f"{c}{s}", fx) for c in fx for s in ("", "/100", "*1000")}
    named_money = F.create_map(*[F.lit(x) for kv in money.items() for x in kv])

    link = [f"__link{i}" for i in range(len(entity))]
    base = cars.select(
        "row_id", "feed", "price", parse_length(F.col("height")).alias("__h"),
        money_unit(F.col("price_unit")).alias("__pu0"), money_unit(F.col("description")).alias("__pu1"),
        *[F.upper(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]", "")).alias(k) for c, k in zip(entity, link)],
    )
    base = materialise(base.withColumn("__pu", F.coalesce("__pu0", "__pu1")).drop("__pu0", "__pu1"), "units")
    stated_h = {r.feed: r.l for r in note_rows if r.feed is not None and r.l}
    stated_p = {r.feed: r.m for r in note_rows if r.feed is not None and r.m in money}
    named = F.try_element_at(named_money, F.col("__pu"))
    height = F.struct(F.lit("height").alias("q"), F.when(F.col("__h.raw").isNotNull(), F.col("feed")).otherwise(STATED).alias("s"), F.coalesce(F.col("__h.inches"), F.col("__h.value")).alias("v"))
    price = F.struct(F.lit("price").alias("q"), F.when(F.col("__pu").isNull(), F.col("feed")).otherwise(STATED).alias("s"), (F.col("price") * F.when(F.col("__pu").isNull(), 1.0).otherwise(named)).alias("v"))
    seen = base.select(*link, F.explode(F.array(height, price)).alias("x")).select(*link, "x.*").filter("v > 0")
    graphs = fit_source_units(seen, "q", link, "s", "v", {"height": ({STATED: "in"} | stated_h, LENGTH_UNITS, "in"), "price": ({STATED: "USD"} | stated_p, money, "USD")})
    gh, gp = graphs["height"], graphs["price"]

    feed_h = source_factor(F.col("feed"), gh, 1.0)
    grouped = F.when(F.abs(feed_h - LENGTH_UNITS["mm"]) < 1e-9, _number(F.col("__h.raw"), F.lit(True))).otherwise(F.col("__h.value"))
    height = F.coalesce(F.col("__h.inches"), grouped * feed_h)
    in_inches = F.when(F.col("__h.inches").isNotNull(), F.col("__h.unit") == "in").when(F.col("__h.raw").isNotNull(), feed_h == 1.0)
    factor = F.coalesce(named, source_factor(F.col("feed"), gp, 1.0))
    out = base.select(
        "row_id", height.alias("height_in"), in_inches.alias("height_recorded_in_inches"),
        F.round(F.col("price") * factor, 6).alias("price_usd"),
        F.when(F.col("price").isNotNull(), factor == 1.0).alias("price_recorded_in_usd"),
    )
    return out


def converted_values(common: DataFrame) -> DataFrame:
    """Long form of the values that weren't in the common unit, rounded to whole units (half up)."""
    h = F.when(F.col("height_in").isNotNull() & ~F.col("height_recorded_in_inches"), F.struct(F.lit("height").alias("f"), F.round("height_in").cast("bigint").alias("v")))
    p = F.when(F.col("price_usd").isNotNull() & ~F.col("price_recorded_in_usd"), F.struct(F.lit("price").alias("f"), F.round("price_usd").cast("bigint").alias("v")))
    long = common.select("row_id", F.explode(F.array_compact(F.array(h, p))).alias("__x"))
    return long.select("row_id", F.col("__x.f").alias("field_name"), F.col("__x.v").alias("common_value"))
