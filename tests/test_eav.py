import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import eav as E

SPEC = [E.Attribute("Doors", "int", ("218",)), E.Attribute("Disp", "double", ("244",)), E.Attribute("Turbo", "boolean", ("277",)), E.Attribute("Make", "string", ("201",))]
SCHEMA = "vin string, hint bigint, variable_id string, value string, at timestamp, slot string, pairs string"


def frame(spark, rows):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(v, h, i, x, t + dt.timedelta(days=d), "s", "p") for v, h, i, x, d in rows], SCHEMA)


def test_wide_and_failures(spark):
    df = frame(spark, [("a", 1, "0218", "4", 0), ("a", 1, "218.0", "+5", 2), ("a", 1, " 244", "2.5", 0), ("a", 1, "277", "Yes", 0), ("a", 1, "201", " KIA ", 0), ("a", 1, "999", "7", 0), ("b", None, "218", "V6", 0), ("b", None, "244", "n/a", 0), (None, 3, "218", "2,013", 0)])
    wide = {(r.vin, r.hint): r for r in E.eav_to_wide(df, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", SPEC, "at").collect()}
    a = wide["a", 1]
    assert (a.Doors, a.Disp, a.Turbo, a.Make, a.cast_failures) == (5, 2.5, True, "KIA", {})
    assert wide["b", None].Doors is None and wide["b", None].cast_failures == {"Doors": "V6"}
    assert wide[None, 3].Doors == 2013


def test_whole_values(spark):
    df = frame(spark, [("a", 1, "218", v, d) for d, v in enumerate(["4", "04", "4.0", " 4 ", "5", "2-4", "four", "V6", "4.5", "", None, "3 stars", "-2", "9223372036854775808"])])
    got = sorted(r.int_value for r in E.whole_values(df, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", SPEC, "at").collect())
    assert got == [-2, 3, 4, 5]


def test_empty_and_hot(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.eav_to_wide(empty, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", SPEC, "at").count() == 0
    hot = frame(spark, [("h", None, "218", str(i % 700), i) for i in range(3000)])
    assert E.whole_values(hot, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", SPEC, "at").count() == 700
    maps = E.entity_maps(hot, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", SPEC, "at")
    assert maps.agg(F.max(F.size("pairs"))).first()[0] == 1
    assert json.dumps(maps.columns) == '["vin", "hint", "slot", "pairs"]'


def test_metadata_with_gaps(spark):
    meta = spark.createDataFrame([("A", "1", "int"), (None, "2", "int"), ("B", None, "int"), ("C", "3", None), ("D", "4", "blob"), ("A", "1", "int")], "variable_code string, variable_id string, data_type string")
    assert E.spec_from_metadata(meta) == [E.Attribute("A", "int", ("1",))]
    two = spark.createDataFrame([("A", "1", "int"), ("A", " 07.0", "int"), ("B", "3", "string")], meta.schema)
    assert E.spec_from_metadata(two) == [E.Attribute("A", "int", ("1", "7")), E.Attribute("B", "string", ("3",))]
    for clash in ([("A", "1", "int"), ("B", "1", "int")], [("A", "1", "int"), ("A", "2", "string")]):
        with pytest.raises(ValueError):
            E.spec_from_metadata(spark.createDataFrame(clash, meta.schema))
    df = frame(spark, [("a", 1, "1", "4", 0), ("a", 1, "7", "5", 0)])
    assert E.whole_values(df, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", E.spec_from_metadata(two)).count() == 2
    assert E.whole_values(df, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", [], "at").count() == 0
    assert E.eav_to_wide(df, ["vin", "hint"], E.clean_id(F.col("variable_id")), "value", [], "at").count() == 0
