"""Scans over blocks of time give what plain windows over whole series give, and deal one long series over many tasks."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import contracts, coverage, derive, scan, scores

H = 3_600_000_000_000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def series(spark, seed, n=160, gap=0.25):
    """Three series with gaps, open bars and off-grid bars, one of a single bar."""
    rng, rows = random.Random(seed), [("one", 5 * H, 1.5, True, 1, 3)]
    for s in ("a", "b", "c"):
        at = rng.randrange(50)
        for i in range(n):
            at += 1 if rng.random() > gap else rng.randint(2, 30)
            rows.append((s, at * H, round(rng.uniform(1, 9), 3), rng.random() > 0.15, i, at * H + H + rng.choice([0, 0, 5, 3 * H, 40 * H])))
            if rng.random() < 0.03:
                rows.append((s, at * H + 7, 2.5, True, 1000 + i, at * H))
    return spark.createDataFrame(rows, "series string, start_ns bigint, close double, finalized boolean, offset bigint, known_ns bigint")


@pytest.mark.parametrize("span", [1, 16])
def test_chains_do_not_depend_on_blocks(spark, span):
    bars = series(spark, 3)
    whole, cut = 10**6 * H, span * H
    for run in (
        lambda s: derive.lag_label(bars, 2, 3, H, s), lambda s: derive.lineage(bars, 4, H, s), lambda s: derive.lagged_returns(bars, 6, H, s),
        lambda s: derive.history_lengths(bars, 5, 2, H, s).drop("history_sum"),
    ):
        assert rows_of(run(cut)) == rows_of(run(whole))
    on_grid = bars.where(F.pmod("start_ns", F.lit(H)) == 0)
    for run in (
        lambda s: derive.gap_counts(on_grid, 7, H, s), lambda s: scores.origins(on_grid, 9, s), lambda s: contracts.known_origins(on_grid, 9, 2, s),
        lambda s: coverage.candle_gaps(on_grid, H, s), lambda s: derive.dense_hours(on_grid, H, s),
    ):
        assert rows_of(run(cut)) == rows_of(run(whole))


def test_scans_equal_plain_windows(spark):
    rng = random.Random(4)
    rows = [(k, o, rng.choice([None, rng.randint(-9, 9)])) for k in ("x", "y") for o in rng.sample(range(-500, 500), 200)] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    for reverse in (False, True):
        w = W.partitionBy("k").orderBy(F.col("o").desc() if reverse else F.col("o"))
        for inclusive in (True, False):
            frame = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
            want = df.select("*", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"), F.max("v").over(frame).alias("m"), F.min("v").over(frame).alias("l"))
            got = scan.prefix(df, ["k"], "o", 37, {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v")), "l": (F.min, F.col("v"))}, inclusive, reverse)
            assert rows_of(got) == rows_of(want)
    w = W.partitionBy("k").orderBy("o")
    want = df.select("*", F.lag("v").over(w).alias("p"), F.lag("o").over(w).alias("po"), F.lead("v").over(w).alias("n"))
    assert rows_of(scan.neighbours(df, ["k"], "o", 37, {"p": "v", "po": "o"}, {"n": "v"})) == rows_of(want)
    ends = spark.createDataFrame([("a", 3, 3), ("b", -5, 70), ("c", 9, 8)], "k string, lo bigint, hi bigint")
    got = scan.grid(ends.where("lo <= hi"), ["k"], 4, 10, "at")
    assert rows_of(got) == sorted([("a", 3)] + [("b", x) for x in range(-5, 71, 4)], key=repr)


def test_segments_books_and_sequences(spark):
    rng = random.Random(5)
    rows = [(p, o, rng.choice("uv"), rng.randint(0, 1)) for p in range(3) for o in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "producer bigint, offset bigint, a string, b bigint")
    want, last, count, number = {}, None, 0, 0
    for p, o, a, b in sorted(rows):
        number = 0 if last is None or last[0] != p else number
        new = last is None or last != (p, a, b) or count == 3
        count, number = (1, number + 1) if new else (count + 1, number)
        want[p, o], last = number, (p, a, b)
    for span in (7, 10_000):
        assert {(r.producer, r.offset): r.segment for r in derive.segments(df, ["a", "b"], 3, span).collect()} == want
    rows = [(s, o, rng.randint(0, 6), rng.random() < 0.2) for s in range(3) for o in rng.sample(range(300), 120)]
    books = spark.createDataFrame(rows, "stream bigint, offset bigint, seq bigint, is_snapshot boolean")
    want, state = {}, {}
    for s, o, q, snap in sorted(rows):
        valid, seq = state.get(s, (False, None))
        now = snap or (valid and q == seq + 1)
        want[s, o], state[s] = (now, valid and not now), (now, q)
    for span in (5, 10_000):
        assert {(r.stream, r.offset): (r.valid, r.loss) for r in coverage.book_validity(books, span).collect()} == want
        seen = coverage.sequence_gaps(books.withColumn("session", F.lit(1)), span)
        assert rows_of(seen) == rows_of(coverage.sequence_gaps(books.withColumn("session", F.lit(1)), 10**9))


def test_one_long_series(spark):
    """Two million bars of one series: every core has its part, and the figures follow from how the bars were made."""
    n = 2_000_000
    bars = spark.range(n).where("id % 1000 <> 7").select(F.lit("s").alias("series"), (F.col("id") * H).alias("start_ns"), F.lit(1.0).alias("close"), (F.col("id") % 1000 != 500).alias("finalized"))
    out = scores.origins(bars, 100)
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.6 * n
    # of 1000 hours one is missing and one open; each spoils the 100 origins whose lookback holds it
    assert {r.reason: r.n for r in out.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {None: n - 99 - 200 * 2000 + 92 + 0, "missing": 100 * 2000 - 92, "not-final": 100 * 2000, "missing-history-boundary": 99}
    labels = derive.lag_label(bars.withColumn("offset", F.lit(0)))
    assert labels.where("label_reason = 'gap-or-missing'").count() == 3 * 2000 + 3
