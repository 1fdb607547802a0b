"""Interval joins and as-of merges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, coverage, intervals

H = 3_600_000_000_000


@pytest.mark.parametrize("unit", [1, 10])
def test_overlaps_against_a_loop(spark, unit):
    rng = random.Random(unit)

    def some(n, longest):
        out = []
        for i in range(n):
            a = rng.randint(-3000, 3000)
            out.append((rng.choice("ab"), a, a + rng.choice([0, 1, 2, rng.randint(1, longest)]), i))
        return out

    left, right = some(120, 300), some(150, 6000)
    spans = spark.createDataFrame(left, "series string, span_start bigint, span_end bigint, i bigint")
    claims = spark.createDataFrame(right, "series string, claim_start bigint, claim_end bigint, j bigint")
    got = [(r.i, r.j) for r in intervals.overlapping(spans, claims, ["series"], unit).select("i", "j").collect()]
    want = [(i, j) for s, a, b, i in left for t, c, d, j in right if s == t and a < b and c < d and a < d and c < b]
    assert sorted(got) == sorted(want)


def test_long_claims_cost_few_rows(spark):
    """Ten years of hours are tens of pieces, a span beyond the greatest size several of that size; pieces cover each hour once."""
    ten = 87_600
    df = spark.createDataFrame([("s", 5 * H, (5 + ten) * H)], "series string, a bigint, b bigint")
    parts = intervals.cut(df, "a", "b", H).collect()
    assert len(parts) < 40
    longer = intervals.cut(spark.createDataFrame([(-7, 2**26)], "a bigint, b bigint"), "a", "b", 1).collect()
    assert len(longer) < 60 and sum(1 << r.size for r in longer) == 2**26 + 7
    covered = sorted((r.piece << r.size, (r.piece + 1) << r.size) for r in parts if r.series == "s")
    assert covered[0][0] == 5 and covered[-1][1] == 5 + ten and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
    gaps = df.where("series = 's'").select("series", F.col("a").alias("gap_start"), F.col("b").alias("gap_end"))
    hours = spark.range(ten).select(F.lit("s").alias("series"), ((F.col("id") + 5) * H).alias("start_ns"))
    assert [tuple(r)[3:] for r in coverage.repair(gaps, hours, False).collect()] == [(ten, ten, "complete")]
    assert [tuple(r)[3:] for r in coverage.repair(gaps, hours.where("start_ns % 7 <> 0"), True).collect()][0][2] == "unknown"


@pytest.mark.parametrize("first", [False, True])
def test_as_of_against_a_loop(spark, first):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, rng.randint(0, 400), 7]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, known bigint, revision bigint, v bigint")
    cutoffs = [-1, 0, 7, *rng.sample(range(420), 25)]
    want = {}
    for k in "ab":
        for c in cutoffs:
            seen = [r[1:] for r in rows if r[0] == k and r[1] is not None and r[1] <= c]
            if seen:
                want[k, c] = (min if first else max)(seen)
    for span in (13, 10**6):
        got = asof.as_of_merge(df, cutoffs, ["k"], "known", "revision", first, span).collect()
        assert {(r.k, r.cutoff): (r.known, r.revision, r.v) for r in got} == want
    table = spark.createDataFrame([("a", 50), ("b", 51), ("b", 51), ("zz", 9)], "k string, cutoff bigint")
    got = asof.as_of_merge(df, table, ["k"], "known", "revision", first).collect()
    assert sorted((r.k, r.cutoff) for r in got) == [("a", 50), ("b", 51)]


def test_a_thousand_cutoffs_in_one_pass(spark):
    """One key with 200,000 revisions, a thousand cutoffs: as many rows as cutoffs, no copy of a revision a cutoff."""
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * H).alias("known"), F.col("id").alias("revision"))
    cutoffs = [i * 200 * H + 5 for i in range(1000)]
    out = asof.as_of_merge(df, cutoffs, ["k"], "known", "revision")
    assert out.where(F.col("revision") != F.expr(f"(cutoff - 5) div {H}")).count() == 0 and out.count() == 1000
    assert "ExpandExec" not in out._jdf.queryExecution().executedPlan().toString()
