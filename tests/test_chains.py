"""Greedy chains and exact quantiles against plain loops, with one group that is far larger than the others."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, forecasts, scores
from tidemark.operators.quantiles import exact_quantiles

H = 3_600_000_000_000


def test_blocks_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(3000) * H) for g, n in (("a", 400), ("b", 30), ("c", 1)) for _ in range(n)]
    want = {}
    for g in "abc":
        last = None
        for at in sorted(x for k, x in rows if k == g):
            if last is None or at >= last + 24 * H:
                last, want[g] = at, want.get(g, 0) + 1
    df = spark.createDataFrame(rows, "g string, start_ns bigint")
    assert {r.g: r.blocks for r in scores.blocks(df, ["g"], 24 * H).collect()} == want
    assert scores.blocks(df.limit(0), ["g"], 24 * H).count() == 0
    ends = chains.next_at_or_after(df.distinct().withColumn("t", F.col("start_ns") + 7), ["g"], "start_ns", "t", 50 * H, "start_ns")
    at = {g: sorted({x for k, x in rows if k == g}) for g in "abc"}
    assert {(r.g, r.start_ns): r.next for r in ends.collect()} == {(g, x): min((y for y in at[g] if y >= x + 7), default=None) for g in "abc" for x in at[g]}


@pytest.mark.parametrize("span", [9, 1 << 20])
def test_batches_against_a_loop(spark, span):
    rng = random.Random(4)
    rows = [(g, o, rng.choice([0, 1, 5, 30, 99, 101, 400])) for g, n in (("a", 300), ("b", 12), ("c", 1)) for o in rng.sample(range(1000), n)]
    want = {}
    for g in "abc":
        batch = count = size = 0
        for _, o, b in sorted(r for r in rows if r[0] == g):
            if count and (count + 1 > 7 or size + b > 100):
                batch, count, size = batch + 1, 0, 0
            count, size = count + 1, size + b
            want[g, o] = batch
    df = spark.createDataFrame(rows, "g string, offset bigint, n_bytes bigint")
    assert {(r.g, r.offset): r.batch for r in forecasts.byte_batches(df, ["g"], 7, 100, span).collect()} == want


def test_a_group_of_a_million_rows(spark):
    """Each hour a row: every 1,000th starts a block, every 10,000th a batch; no task holds the group."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("s").alias("series"), (F.col("id") * H).alias("start_ns"), F.col("id").alias("offset"), F.lit(10).cast("bigint").alias("n_bytes"))
    assert [tuple(r) for r in scores.blocks(rows, ["series"], 1000 * H).collect()] == [("s", 1000)]
    out = forecasts.byte_batches(rows, ["series"], 10_000, 10**9, 1 << 16).persist()
    assert out.where(F.col("batch") != F.expr("offset div 10000")).count() == 0 and out.count() == n
    assert max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 0.7 * n


def test_quantiles_equal_percentile(spark):
    """To the last bit, for one group of most rows, ties, single rows, huge ranges and nulls."""
    big = spark.range(200_000).select(F.lit("big").alias("g"), (F.pow(F.rand(5), 9.0) * 1e6 - 17).alias("v"))
    rng = random.Random(6)
    small = [(g, v) for g, vs in {"one": [2.5], "same": [1.0] * 900, "none": [None], "wide": [1e308, -1e308, 5e-324, 0.0, -0.0] * 60, "ties": [rng.randint(0, 3) / 7 for _ in range(5000)], "mixed": [rng.gauss(0, 10.0 ** rng.randint(-9, 9)) for _ in range(3000)]}.items() for v in vs]
    df = big.unionByName(spark.createDataFrame(small, "g string, v double"))
    at = {"q0": 0.0, "q025": 0.025, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q975": 0.975, "q100": 1.0}
    want = {r.g: tuple(r)[1:] for r in df.where("v is not null").groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in at.items()]).collect()}
    for options in ({}, {"few": 400, "bins": 64}):
        got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", at, **options).collect()}
        assert got == want
    assert exact_quantiles(df.limit(0), ["g"], "v", at).count() == 0
