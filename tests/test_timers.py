"""State that ends: timers, late rows, restarts in mid-stream."""

from pyspark.sql import functions as F

from tidemark.streaming import timers

HOUR = 3_600_000


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder, schema):
    return spark.readStream.schema(schema + ", ts timestamp").parquet(folder).withWatermark("ts", "0 seconds")


def kept(spark, home, schema="kind string, revisions bigint, offset bigint, series string, start_ns bigint"):
    rows = spark.read.schema(schema).parquet(f"{home}/rows").collect()
    return rows, spark.read.schema(schema).parquet(f"{home}/late").collect()


def test_candles_close_and_restart(spark, tmp_path):
    """Revisions live until their candle closes; a stream stopped and started again gives the kinds of one pass."""
    schema = "series string, start_ns bigint, offset bigint, revision string, finalized boolean, at_ms bigint"
    home, folder = str(tmp_path / "out"), str(tmp_path / "in")
    row = lambda hour, offset, revision, final, at: ("s", hour * HOUR * 1_000_000, offset, revision, final, at * HOUR)
    put(spark, folder, [row(0, 1, "a", False, 0), row(0, 2, "a", False, 0), row(0, 3, "b", True, 0)], schema)
    timers.split(timers.classified(read(spark, folder, schema)), home)
    put(spark, folder, [row(0, 4, "b", True, 1), row(0, 5, "c", True, 1), row(1, 6, "d", False, 1)], schema)
    timers.split(timers.classified(read(spark, folder, schema)), home)
    put(spark, folder, [row(9, 7, "e", False, 9)], schema)
    grown = timers.split(timers.classified(read(spark, folder, schema)), home)
    put(spark, folder, [row(0, 8, "a", False, 0), row(9, 9, "e", False, 9)], schema)
    timers.split(timers.classified(read(spark, folder, schema)), home)
    rows, late = kept(spark, home)
    kinds = {r.offset: r.kind for r in rows if r.offset is not None}
    assert kinds == {1: "accepted", 2: "duplicate", 3: "finalization", 4: "duplicate", 5: "conflict", 6: "accepted", 7: "accepted", 9: "duplicate"}
    assert sorted((r.start_ns // (HOUR * 1_000_000), r.revisions) for r in rows if r.kind == "closed") == [(0, 3), (1, 1)]
    assert [r.offset for r in late] == [8]
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, grown.recentProgress) if p["stateOperators"]]
    assert totals[-1] < totals[0]


def test_streams_go_stale(spark, tmp_path):
    """Gaps, book losses and late numbers as in H10; a quiet stream is told once, its state goes, a later row starts anew."""
    schema = "stream string, offset bigint, seq bigint, snapshot boolean, at_ms bigint"
    home, folder = str(tmp_path / "out"), str(tmp_path / "in")
    put(spark, folder, [("a", 1, 5, True, 0), ("a", 2, 6, False, 0), ("a", 3, 9, False, 0), ("a", 4, 7, False, 0), ("b", 5, 1, False, 0)], schema)
    timers.split(timers.watched(read(spark, folder, schema), HOUR), home)
    put(spark, folder, [("b", 6, 2, False, 3 * HOUR)], schema)
    timers.split(timers.watched(read(spark, folder, schema), HOUR), home)
    put(spark, folder, [("a", 7, 40, False, 3 * HOUR), ("a", 8, 42, False, 3 * HOUR), ("b", 9, 3, False, HOUR)], schema)
    timers.split(timers.watched(read(spark, folder, schema), HOUR), home)
    rows, late = kept(spark, home, "stream string, kind string, first_seq bigint, last_seq bigint, offset bigint")
    assert sorted((r.stream, r.kind, r.first_seq, r.last_seq) for r in rows) == [("a", "book-loss", 9, 9), ("a", "gap", 7, 8), ("a", "gap", 41, 41), ("a", "stale", 9, 9)]
    assert sorted((r.stream, r.offset) for r in late) == [("a", 4), ("b", 9)]
