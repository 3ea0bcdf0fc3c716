import math
import random

from pyspark.sql import functions as F

from tallyframe.operators import units as U


def test_parse_length(spark):
    cases = {
        "69.5 inches": 69.5, " 42 IN. ": 42.0, '55.5"': 55.5, "77 3/4 in": 77.75, "78,6 in": 78.6, "5' 2\"": 62.0, "5′10″": 70.0, "4 feet 11 inches": 59.0, "4ft 5in": 53.0,
        "127 cm": 50.0, "1,895 mm": 1895 / 25.4, "1,377 mtr": 137.7 / 2.54, "138,7 centimetres": 138.7 / 2.54, "5.67 feet": 68.04, "1844MM": 1844 / 25.4,
        "59.2": None, "TBD": None, "--": None, "": None, None: None, "12 parsecs": None, "inf": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", U.parse_length(F.col("h")).alias("p")).collect()
    for r in rows:
        got, want = (r.p.inches if r.p else None), cases[r.h]
        assert (got is None) if want is None else math.isclose(got, want, rel_tol=1e-9), (r.h, got, want)
    bare = [r for r in rows if r.h == "59.2"][0].p
    assert bare.raw == "59.2" and bare.value == 59.2


def test_money_unit(spark):
    cases = {"US$": "USD", "C$": "CAD", "CDN$": "CAD", "Mex$": "MXN", "€": "EUR", "USc": "USD/100", "US cents": "USD/100", "cent": "USD/100", "k$": "USD*1000", "USD x1000": "USD*1000", "Heights in centimetres.": None, "price in thousands of dollars": "USD*1000", None: None}
    for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", U.money_unit(F.col("t")).alias("u")).collect():
        assert r.u == cases[r.t], r.t


def fit(df, stated, factors, default):
    return U.fit_source_units(df.withColumn("q", F.lit("x")), "q", ["m"], "s", "v", {"x": (stated, factors, default)})["x"]


def test_graph_spreads_and_snaps(spark):
    """Unnamed sources get the unit that the shared entities imply; a stated unit always holds."""
    rows = []
    for m in range(40):
        h = 50 + m * 0.5
        rows += [(f"m{m}", "a", h), (f"m{m}", "b", h * 2.54), (f"m{m}", "c", h * 25.4 * 1.003), (f"m{m}", "d", h), (f"m{m}", "e", h / 12)]
    rows += [("m0", "a", float("nan")), ("m0", None, 3.0), (None, "a", 9.0), ("m1", "alone", None), ("only", "apart", 4.0)]
    df = spark.createDataFrame(rows, "m string, s string, v double")
    g = fit(df, {"b": "cm", "e": "in"}, U.LENGTH_UNITS, "in")
    assert {k: g.units[k] for k in "abcd"} == {"a": "in", "b": "cm", "c": "mm", "d": "in"}
    assert g.units["e"] == "in" and g.conflicts["e"] == "ft"
    assert g.units["apart"] == "in" and "alone" not in g.units


def test_offset_decides(spark):
    """Celsius and Kelvin have one scale; only the offset tells them apart, through a source linked by another."""
    rng = random.Random(3)
    rows = []
    for m in range(60):
        c = rng.uniform(-15, 45)
        noise = lambda: rng.gauss(0, 0.3) + (rng.random() < 0.05) * 400
        rows += [(f"m{m}", "plain", c + noise()), (f"m{m}", "f", c * 9 / 5 + 32 + noise()), (f"m{m}", "far", c + 273.15 + noise() / 50 + 0.0)]
    df = spark.createDataFrame(rows, "m string, s string, v double")
    g = fit(df, {"plain": "C"}, U.TEMPERATURE_UNITS, "C")
    assert g.units == {"plain": "C", "f": "F", "far": "K"}
    wide = df.withColumn("x", U.to_common(F.col("v"), F.col("s"), g)).groupBy("m").pivot("s", ["plain", "f", "far"]).agg(F.max("x"))
    off = wide.agg(F.median(F.abs(F.col("f") - F.col("plain"))).alias("f"), F.median(F.abs(F.col("far") - F.col("plain"))).alias("k")).first()
    assert off.f < 1 and off.k < 1


def test_feeds_without_any_note(spark):
    """Only the graph can tell the units of these feeds: values that name their unit are the anchor."""
    rng = random.Random(5)
    rows, want = [], {}
    kinds = {"a": 1.0, "b": 2.54, "c": 25.4, "d": 1 / 12}
    for i in range(600):
        m = rng.randrange(30)
        inches = 50 + m + rng.gauss(0, 0.4)
        feed = rng.choice(list(kinds))
        named = rng.random() < 0.15
        rows.append((i, feed, f"{inches:.2f} in" if named else f"{inches * kinds[feed]:.3f}", 100, "USD", None, "Make", f"m{m}"))
        if not named and feed != "a":
            want[i] = round(inches)
    cars = spark.createDataFrame(rows, "row_id bigint, feed string, height string, price bigint, price_unit string, description string, make_name string, model_name string")
    notes = spark.createDataFrame([(f, None) for f in kinds], "feed string, note string")
    fx = spark.createDataFrame([("USD", 1.0)], "currency string, usd_per_unit double")
    got = {r.row_id: r.common_value for r in U.converted_values(U.common_units(cars, notes, fx)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1 for i in want)
    alone = U.solve_units([], sorted(kinds), {}, U.LENGTH_UNITS, "in")
    assert set(alone.units.values()) == {"in"}  # without the graph no row would be converted


def test_common_units_edges(spark):
    cars = spark.createDataFrame(
        [(1, "x", None, None, None, None, "A", "B", "extra"), (2, "n", "1500", 100, None, None, "A", "B", ""), (3, None, "60", 7, "k$", None, None, None, ""), (3, None, "60", 7, "k$", None, None, None, ""), (4, "n", "5 ft", 50, None, "asking in CAD, firm", "A", "B", "")],
        "row_id bigint, feed string, height string, price bigint, price_unit string, description string, make_name string, model_name string, common_value string",
    )
    notes = spark.createDataFrame([("n", "Body measurements are millimetres. Amounts in euro."), ("x", None)], "feed string, note string")
    fx = spark.createDataFrame([("USD", 1.0), ("EUR", 1.1), ("CAD", 0.75)], "currency string, usd_per_unit double")
    got = sorted(tuple(r) for r in U.converted_values(U.common_units(cars, notes, fx)).collect())
    assert got == [(2, "height", 59), (2, "price", 110), (3, "price", 7000), (3, "price", 7000), (4, "height", 60), (4, "price", 38)]
    none = U.converted_values(U.common_units(cars.limit(0), notes, fx))
    assert none.count() == 0
