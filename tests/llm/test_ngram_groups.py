"""Groups of classes that share a frequent signature."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.llm.shared import SHUFFLES_GO, durable


def test_frequent_signature_gives_no_pairs(spark):
    """Four hundred unlike sets of a thousand n-grams share one signature, two of them are near copies: one pair goes on."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 1000, np.uint64)) for _ in range(400)]
    sets.append(np.sort(np.append(sets[0][40:], rng.integers(0, 2**63, 40, np.uint64))))
    rows = [(7, i, len(s), i, *ngram_join.parities(s).tolist(), ngram_join.parities(s, ngram_join.SKETCH).tolist()) for i, s in enumerate(sets)]
    apart = spark.createDataFrame(rows, "sig bigint, cls bigint, n bigint, component bigint, " + ", ".join(f"{p} bigint" for p in ngram_join.PARITY) + ", sketch array<bigint>")
    assert [(r.a, r.b) for r in ngram_join.across(apart, 80).collect()] == [(0, 400)]


def test_sketches_are_shuffled_once(spark):
    """Both sides of the join across components read the same shuffle."""
    rows = [(i // 3, i, 5, i, *[0] * len(ngram_join.PARITY), [0] * (ngram_join.SKETCH // 64)) for i in range(30)]
    apart = durable(spark.createDataFrame(rows, "sig bigint, cls bigint, n bigint, component bigint, " + ", ".join(f"{p} bigint" for p in ngram_join.PARITY) + ", sketch array<bigint>"), "apart")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = ngram_join.across(apart, 80)
        assert pairs.count() == 30
        pairs.collect()
        assert pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ReusedExchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_with_the_write(spark):
    """A durable table leaves no shuffle files behind, and the session's own setting comes back."""
    have = lambda: {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before, setting = have(), spark.conf.get(SHUFFLES_GO, None)
    groups = durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "groups")
    for _ in range(50):  # removal is told to the block managers and not waited for
        if not (left := have() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLES_GO, None) == setting
    assert len(groups.collect()) == 7


def test_wide_sketches_tell_large_sets_apart(spark):
    """Unlike sets of 7,000 n-grams pass the long parities but not the wide ones; near copies pass, also with other widths."""
    rng = np.random.default_rng(6)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n, np.uint64))
    large, small = fresh(7000), fresh(2000)
    pairs = [(large, fresh(7000)), (large, np.sort(np.append(large[600:], fresh(600)))), (fresh(4090), None), (small, np.append(small, fresh(100)))]
    pairs[2] = (pairs[2][0], np.append(pairs[2][0], fresh(300)))
    listed = lambda x: None if x is None else x.tolist()
    rows = [(i, len(a), len(b), *(f(s).tolist() for s in (a, b) for f in [lambda s: ngram_join.parities(s, ngram_join.SKETCH)]), *(listed(ngram_join.wide_parities(s)) for s in (a, b))) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, na bigint, nb bigint, sketch array<bigint>, sketch_2 array<bigint>, wide array<bigint>, wide_2 array<bigint>")
    assert [len(r.wide or []) - len(r.wide_2 or []) for r in df.orderBy("i").collect()] == [0, 0, -64, -64]
    assert sorted(r.i for r in df.where(ngram_join.sketched(80)).collect()) == [0, 1, 2, 3]
    assert sorted(r.i for r in df.where(ngram_join.sketched(80) & ngram_join.widely(80)).collect()) == [1, 2, 3]
