"""Centroid clustering against plain Lloyd rounds in Python integers, and against SQL."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k, rounds, size, seed=3):
    vectors = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(vectors, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "z")
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in vectors:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    out = [(i, nearest(v)) for i, v in vectors]
    total = [sum(d for _, (d, c) in out if c == j) for j in range(k)]
    fit = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, fit(d), fit(total[c]), fit(sum(total)), digest[c]) for i, (d, c) in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hard_vectors(spark):
    """Ties, repeats, a third of the rows alike, nulls, wrong sizes, non-finite values, clashing columns; fewer vectors than centroids."""
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) / 1024 for _ in range(4)]) for i in range(150)] + [(1000 + i, [0.25, -0.5, 0.125, 1.0]) for i in range(80)]
    rows += [(5, [0.1, 0.2, 0.3, 0.4])] * 2 + [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0] * 5), (2004, [1.0, None, 1.0, 1.0]), (2005, [math.nan, 1.0, 1.0, 1.0]), (2006, [math.inf, 1.0, 1.0, 1.0]), (-7, [-1e-9, 1e-9, 0.0, -0.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("values", "hash", "parts", "apart", "cluster"))])
    for k in (1, 3, 8):
        assert rows_of(clusters.clustered(df, k=k, rounds=4, size=4)) == brute(rows, k, 4, 4)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert rows_of(clusters.clustered(few, rounds=2, size=4)) == brute(rows[:3], 8, 2, 4)[:3]
    assert clusters.clustered(df.limit(0), size=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clusters.clustered(df.limit(0), size=4).count() == 0


def test_huge_components(spark):
    """Values beyond 64 bits stay exact; distances that no bigint holds are null."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([1.0, -3.5, 2.0**40, -(2.0**41), 3e38, 1e300]) * rng.random() for _ in range(3)]) for i in range(40)] + [(50 + i, [rng.random() for _ in range(3)]) for i in range(20)]
    got = clusters.clustered(spark.createDataFrame(rows, SCHEMA), k=4, rounds=3, size=3)
    assert rows_of(got) == brute(rows, 4, 3, 3)


def test_pivots_spare_distances():
    """Bounds leave the result as it is and most distances unmeasured where clusters lie apart."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-20_000, 20_000, (40, 16))
    x = centres[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 16))
    pivots = clusters.as_rows(clusters.far_apart(x[:200].tolist(), 12))
    apart = np.stack([clusters.roots(clusters.squared(x, p)) for p in pivots], axis=1)
    between = np.stack([clusters.roots(clusters.squared(centres, p)) for p in pivots], axis=1)
    best, distance, measured = clusters.assigned(x, apart, centres, between)
    plain = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert measured < 0.1 * plain.size


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = rows_of(clusters.op13_centroid_clustering(spark, DATA))
    assert got == brute(rows, 8, 10, 64)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert got == sorted(con.sql(clusters.lloyd_sql()).fetchall(), key=str)
