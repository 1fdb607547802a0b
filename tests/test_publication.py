"""One commit makes a segment visible; the source with offsets gives each row once; streams joined by intervals."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage
from tidemark.sources import publication as pub
from tidemark.sources.offsets import OffsetArchive
from tidemark.streaming import joins

H = 3_600_000_000_000
T = 1000 * H


def rows_of(spark, first, last, value="x"):
    return spark.range(first, last + 1).select(F.col("id").alias("offset"), F.lit(value).alias("value"))


def test_writers(spark, tmp_path):
    """Eight writers at once: one commits, equal rows are told from others, and one whole copy is visible."""
    home, schema = str(tmp_path), rows_of(spark, 0, 1).schema
    pub.staged(rows_of(spark, 0, 50), home, "one")
    with pytest.raises(Exception, match="broken"):
        pub.publish(rows_of(spark, 0, 9).withColumn("value", F.when(F.col("offset") == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise("x")), home, "one")
    with ThreadPoolExecutor(8) as pool:
        told = list(pool.map(lambda i: pub.publish(rows_of(spark, 0, 99, "x" if i % 2 else "y"), home, "one"), range(8)))
    assert sorted(told) == ["already"] * 3 + ["committed"] + ["conflict"] * 4
    back = pub.committed(spark, home, schema).collect()
    assert sorted(r.offset for r in back) == list(range(100)) and len({r.value for r in back}) == 1
    assert pub.recover(spark, home, 3_600_000) == {}
    assert set(pub.recover(spark, home, 0).values()) == {"abandoned"}
    assert pub.committed(spark, home, schema).count() == 100


def test_a_whole_attempt_goes_forward(spark, tmp_path):
    home = str(tmp_path)
    entry = pub.staged(rows_of(spark, 0, 9), home, "two")
    assert pub.commits(spark, home).count() == 0 if (tmp_path / "commits").exists() else True
    assert pub.recover(spark, home, 0) == {entry["attempt"]: "rolled-forward"}
    assert pub.publish(rows_of(spark, 0, 9), home, "two") == "already"
    assert pub.committed(spark, home, rows_of(spark, 0, 1).schema).count() == 10


def test_appended_segments(spark, tmp_path):
    home = str(tmp_path)
    told = [pub.append(rows_of(spark, a, b, v), home, "offset") for a, b, v in ((0, 9, "x"), (10, 19, "x"), (0, 9, "x"), (15, 29, "x"), (10, 19, "y"), (25, 29, "x"), (5, 4, "x"))]
    assert told == ["committed", "committed", "already", "conflict", "conflict", "committed", "empty"]
    assert [(r.name, r.first, r.last) for r in pub.commits(spark, home).orderBy("name").collect()] == [("000000000000", 0, 9), ("000000000001", 10, 19), ("000000000002", 25, 29)]


@pytest.mark.parametrize("after", [-1, 3, 9, 14])
def test_offsets_resume(spark, tmp_path, after):
    """Begun behind any row, stopped and resumed: each row behind it once, none that is not committed."""
    home, out = str(tmp_path / "home"), str(tmp_path / "out")
    spark.dataSource.register(OffsetArchive)
    for first, last in ((0, 9), (10, 19), (30, 31)):
        pub.append(rows_of(spark, first, last).repartition(2), home, "offset")
        pub.staged(rows_of(spark, 20, 25), home, "next", "offset")
        stream = spark.readStream.format("offset_archive").schema("value string, offset bigint").option("path", home).option("after", after).load()
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.offset for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [n for n in [*range(20), 30, 31] if n > after]


def test_joined_streams(spark, tmp_path):
    """Pairs are those of the batch join over several runs, spans without a claim come out once, and the state shrinks."""
    spans = [("a", k * H, (k + 2) * H) for k in range(0, 60, 3)] + [("b", H // 2, H), ("b", H, H)]
    claims = [("a", k * H, (k + 4) * H, "complete") for k in range(2, 30, 5)] + [("b", 0, H // 2, "complete"), ("b", H - 1, H + 1, "pending"), ("z", 200 * H, 201 * H, "pending")]
    kinds = {"span": "series string, span_start bigint, span_end bigint", "claim": "series string, claim_start bigint, claim_end bigint, status string"}
    spans = [(k, a + T, b + T) for k, a, b in [*spans, ("z", 200 * H, 201 * H)]]
    claims = [(k, a + T, b + T, s) for k, a, b, s in claims]
    home, sizes = str(tmp_path), []
    for low, high in ((0, 10), (10, 40), (40, 500)):
        for name, rows in (("span", spans), ("claim", claims)):
            spark.createDataFrame([r for r in rows if low * H <= r[1] - T < high * H], kinds[name]).coalesce(1).write.mode("append").parquet(f"{home}/{name}")
        read = {n: spark.readStream.schema(s).parquet(f"{home}/{n}") for n, s in kinds.items()}
        both = joins.overlapping(read["span"], read["claim"], ["series"], 2 * H, 4 * H)
        run = both.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, run.recentProgress) if p["stateOperators"]]
    got = spark.read.schema("series string, span_start bigint, span_end bigint, claim_start bigint, claim_end bigint, status string").parquet(f"{home}/rows")
    left, right = spark.createDataFrame(spans, kinds["span"]), spark.createDataFrame(claims, kinds["claim"])
    want = coverage.overlapping(left, right)
    key = lambda df: sorted(tuple(r) for r in df.select("series", "span_start", "claim_start").collect())
    assert key(got.where("claim_start is not null")) == key(want)
    alone = sorted((r.series, r.span_start) for r in got.where("claim_start is null").collect())
    met = {(s, a) for s, a, _ in key(want)}
    assert alone == sorted((s, a) for s, a, _ in spans if (s, a) not in met)
    assert sizes[-1] < max(sizes)


def test_a_span_too_long_is_an_error(spark, tmp_path):
    spark.createDataFrame([("a", 0, 5 * H)], "series string, span_start bigint, span_end bigint").write.parquet(f"{tmp_path}/span")
    spark.createDataFrame([("a", 0, H)], "series string, claim_start bigint, claim_end bigint").write.parquet(f"{tmp_path}/claim")
    read = {n: spark.readStream.schema(f"series string, {n}_start bigint, {n}_end bigint").parquet(f"{tmp_path}/{n}") for n in ("span", "claim")}
    run = joins.overlapping(read["span"], read["claim"], ["series"], 2 * H, H).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="longer than"):
        run.awaitTermination()
