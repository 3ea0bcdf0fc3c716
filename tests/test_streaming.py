from tallyframe.streaming import windows as ST


def drive(q):
    q.processAllAvailable()
    q.stop()


def events(spark, tmp_path, parts):
    import datetime as dt

    for i, rows in enumerate(parts):
        spark.createDataFrame([(u, dt.datetime(2026, 1, 1, h, m), v) for u, h, m, v in rows], "user string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    batch = events(spark, tmp_path, [[("a", 1, 0, 1.0), ("a", 1, 10, 2.0)], [("b", 2, 0, 5.0), ("a", 3, 0, 1.0)]])
    stream = ST.event_stream(spark, str(tmp_path / "in"), batch)
    q = ST.tumbling(stream, "ts", ["user"], "1 hour", "1 hour").writeStream.outputMode("update").format("memory").queryName("tumbled").start()
    drive(q)
    want = {(r.window_start, r.user): (r.n, r.total) for r in ST.tumbling(batch, "ts", ["user"], "1 hour").collect()}
    got = {(r.window_start, r.user): (r.n, r.total) for r in spark.table("tumbled").collect()}
    assert got == want


def test_running_totals(spark, tmp_path):
    batch = events(spark, tmp_path, [[("a", 1, 0, 1.0)], [("a", 2, 0, 4.0), ("b", 2, 0, 2.0)]])
    stream = ST.event_stream(spark, str(tmp_path / "in"), batch)
    q = ST.running_totals(stream, "user", "value").writeStream.outputMode("update").format("memory").queryName("running").start()
    drive(q)
    last = {}
    for r in spark.table("running").collect():
        last[r.user] = max(last.get(r.user, (0, 0.0)), (r.n, r.total))
    assert last == {"a": (2, 5.0), "b": (1, 2.0)}


def test_sessions(spark, tmp_path):
    batch = events(spark, tmp_path, [[("a", 1, 0, 1.0), ("a", 1, 20, 1.0), ("a", 3, 0, 1.0)]])
    assert sorted(r.n for r in ST.sessions(batch, "ts", ["user"], "30 minutes").collect()) == [1, 2]
