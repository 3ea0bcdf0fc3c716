import json

from pyspark.sql import functions as F

from tallyframe.sources import fetch as FE


def server():
    def answer(url):
        if url.endswith("gone"):
            return 404, None
        if url.endswith("boom"):
            raise ValueError(url)
        if url.endswith("busy"):
            return 503, None
        return 200, json.dumps({"Results": [{"Model-Name": "CX 5", "id": 1}, {"modelname": "RAV4"}, {}], "url": url})

    return answer


def test_states_and_retries(spark):
    answer = server()
    req = spark.createDataFrame([("a", "u/a"), ("a", "u/a"), ("g", "u/gone"), ("b", "u/busy"), ("x", "u/boom"), (None, "u/n")], "key string, url string")
    state = spark.createDataFrame([], FE.STATE)
    now = lambda s: F.timestamp_seconds(F.lit(s))
    todo = FE.due(req, state, now(0))
    assert sorted(r.key for r in todo.collect()) == ["a", "b", "g", "x"]
    state = spark.createDataFrame(FE.advance(state, FE.fetch(todo, answer, per_second=1000, tasks=2), now(0), wait=60, most=2).collect(), FE.STATE)
    assert {r.key: (r.state, r.attempts) for r in state.collect()} == {"a": ("complete", 1), "g": ("absent", 1), "b": ("waiting", 1), "x": ("waiting", 1)}
    assert FE.due(req, state, now(59), 2).count() == 0 and sorted(r.key for r in FE.due(req, state, now(60), 2).collect()) == ["b", "x"]
    again = spark.createDataFrame(FE.advance(state, FE.fetch(FE.due(req, state, now(60), 2), answer, per_second=1000, tasks=1), now(60), most=2).collect(), FE.STATE)
    assert {r.key: r.state for r in again.collect()} == {"a": "complete", "g": "absent", "b": "failed", "x": "failed"}
    lost = FE.advance(again, spark.createDataFrame([("a", "u/a", 503, None)], "key string, url string, status int, body string"), now(99))
    kept = lost.filter("key = 'a'").first()
    assert kept.state == "complete" and "CX 5" in kept.body
    rows = sorted((r.key, r.place, r.model, r.id) for r in FE.json_rows(again, "$.Results", {"model": "Model Name", "id": "ID"}).collect())
    assert rows == [("a", 0, "CX 5", "1"), ("a", 1, "RAV4", None), ("a", 2, None, None)]


def test_files_and_decodes(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Make": "KIA", "make": "x", "Doors": 4}')
    assert FE.http_get((tmp_path / "p.json").as_uri())[0] == 200 and FE.http_get((tmp_path / "none.json").as_uri())[0] == 0
    rows = [("v1", "u", "complete", 1, None, '{"Make": "KIA", "Doors": 4}', None), ("v2", "u", "complete", 1, None, '{"Trim": "LX"}', None), ("v3", "u", "complete", 1, None, "broken", None), ("v4", "u", "waiting", 1, None, None, None)]
    wide = FE.widen_decodes(spark.createDataFrame(rows, FE.STATE), ["make"])
    assert wide.columns == ["key", "Doors", "json_Make", "Trim"]
    assert {r.key: (r.Doors, r.json_Make, r.Trim) for r in wide.collect()} == {"v1": ("4", "KIA", None), "v2": (None, None, "LX")}
