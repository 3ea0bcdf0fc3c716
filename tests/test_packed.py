import pytest

from tallyframe.operators.packed import explode_packed


def labels(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, o string, pos string, label int")
    out = {}
    for r in explode_packed(df, ["id"], "o").orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append((r.pos, r.label))
    return [out.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("['Leather Seats', 'A/C']", ["Leather Seats", "A/C"]),
        ('["Bed Liner 5\' 6\\"", "360\\u00b0 Camera"]', ["Bed Liner 5' 6\"", "360° Camera"]),
        ("['Bed Liner 5\\' 6\"', \"Driver's Pack\"]", ["Bed Liner 5' 6\"", "Driver's Pack"]),
        ('18" Wheels, "Roof, Satin"', ['18" Wheels', "Roof, Satin"]),
        ("a;; b |c,\t d\n", ["a", "b", "c", "d"]),
        ("• One\n• Two", ["One", "Two"]),
        ('{"A";"B, C"}', ["A", "B, C"]),
        ("['x', , 'y',]", ["x", "y"]),
        ("Park Assist (Front & Rear)|Tow/Haul", ["Park Assist (Front & Rear)", "Tow/Haul"]),
        ('"18"" Alloy, big",b', ['18" Alloy, big', "b"]),
        ("mark0, 'q, r'", ["mark0", "q, r"]),
        ("same, same", ["same", "same"]),
        ("", []), ("  ", []), ("--", []), ("[]", []), ('""', []), (None, []), (";;|", []),
    ],
)
def test_labels(spark, text, want):
    assert labels(spark, text)[0] == list(enumerate(want, 1))


def test_long_and_empty(spark):
    long = ", ".join(f"label {i}" for i in range(5000))
    assert len(labels(spark, long)[0]) == 5000
    empty = spark.createDataFrame([], "id int, o string")
    assert explode_packed(empty, ["id"], "o").count() == 0


def test_key_clash(spark):
    with pytest.raises(ValueError):
        explode_packed(spark.createDataFrame([(1, "a")], "pos int, o string"), ["pos"], "o")
