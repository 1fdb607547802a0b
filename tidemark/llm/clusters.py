"""Clustering around centroids with a table of pivot distances (LAESA).

Vectors become integers, floor(1024 * x) by component. Pivots are fixed: far apart from each other, chosen from a bounded
number of vectors by their hash. One pass writes each vector's components and its distances to the pivots to the shared
folder. In each round the differences between a vector's and a centroid's pivot distances bound their distance
from below; the centroid with the least bound is measured first, and only centroids whose bound does not exceed that are
measured exactly, in integers. Sums by cluster and component leave each task as at most k times d numbers, so a cluster
that holds most vectors gathers nowhere, and the driver gets k times d sums a round. Rounds read the written table, so a lost
executor costs its own tasks alone.

Vectors without exactly ``size`` components, with null or non-finite components, or that are null are left out. Repeated
vectors and ids count each; equal hashes go by id, then components. With fewer vectors than centroids there are as
many centroids as vectors; an empty table gives an empty one. Components of any finite size are exact; a distance or inertia
that no bigint holds is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import durable

#: Components up to this size keep all squared distances within 64 bits; vectors with larger ones are counted in Python integers.
PLAIN = 1 << 27
#: Sums travel in limbs of so many bits.
LIMB = 40
LONGEST = (1 << 63) - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x) for any finite x."""
    return math.floor(scale * x) if abs(x) < 2.0**500 else int(x) * scale


def as_integers(values: np.ndarray, scale: int) -> np.ndarray:
    """A matrix of int64, or of Python integers where a component is beyond PLAIN."""
    if not values.size or np.abs(values).max() < PLAIN // scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[whole(float(x), scale) for x in row] for row in values], object).reshape(values.shape)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to a point."""
    if rows.dtype == object or point.dtype == object:
        return np.array([sum(int(d) * int(d) for d in row - point) for row in rows.astype(object)], object)
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def kept(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and parts (binary: int64 components; decimals where one is beyond PLAIN) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("values").to_pylist(), np.float64).reshape(-1, size)
            plain = np.abs(values).max(axis=1, initial=0) < PLAIN // scale
            near = as_integers(np.where(plain[:, None], values, 0.0), scale)
            parts = [near[i].tobytes() if p else decimals(as_integers(values[i : i + 1], scale)[0]) for i, p in enumerate(plain.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(parts, pa.binary())], ["vec_id", "parts"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("values"))
    fit = F.expr("size(values) = {} and not exists(values, x -> x is null or isnan(x) or abs(x) = double('infinity'))".format(int(size)))
    return rows.where(fit).mapInArrow(run, "vec_id bigint, parts binary")


def decimals(row: np.ndarray) -> bytes:
    """Components in decimal; unlike plain ones never a multiple of eight bytes."""
    out = ",".join(map(str, row.tolist())).encode()
    return out if len(out) % 8 else out + b","


def matrix(parts: list[bytes], size: int) -> np.ndarray:
    """Components of a batch; one matrix of Python integers if any vector needs them."""
    if all(len(p) % 8 == 0 for p in parts):
        return np.frombuffer(b"".join(parts), np.int64).reshape(-1, size)
    return np.array([row_of(p) for p in parts], object).reshape(-1, size)


def row_of(part: bytes) -> list[int]:
    return [int(x) for x in part.rstrip(b",").split(b",")] if len(part) % 8 else np.frombuffer(part, np.int64).tolist()


def far_apart(rows: list[list[int]], count: int) -> list[list[int]]:
    """Pivots as in LAESA: each next one has the greatest sum of distances to those before."""
    table = as_rows(rows)
    chosen, total = [0], np.zeros(len(rows))
    while len(chosen) < min(count, len(rows)):
        total += roots(squared(table, table[chosen[-1]]))
        total[chosen] = -1.0
        if (top := int(total.argmax())) in chosen or total[top] <= 0:
            break
        chosen.append(top)
    return [rows[i] for i in chosen]


def as_rows(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) >= PLAIN for row in rows for x in row)
    return np.array(rows, object if wide else np.int64)


def roots(squares: np.ndarray) -> np.ndarray:
    """Distances in floating point; infinite ones only bound less."""
    if squares.dtype == object:
        return np.array([math.sqrt(x) if x < 10**300 else math.inf for x in squares.tolist()])
    return np.sqrt(squares.astype(np.float64))


def assigned(rows: np.ndarray, pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many distances were measured."""
    n, k = len(rows), len(centroids)
    bounds = np.zeros((n, k))
    with np.errstate(invalid="ignore"):
        for p in range(pivots.shape[1]):
            np.maximum(bounds, np.nan_to_num(np.abs(pivots[:, p, None] - centroid_pivots[None, :, p]), nan=0.0, posinf=0.0), out=bounds)
    # the roots are rounded: a bound gives way by more than their error
    bounds = np.maximum(bounds - 1e-9 * (1.0 + pivots.max(axis=1, initial=0.0, where=np.isfinite(pivots))[:, None] + np.where(np.isfinite(centroid_pivots), centroid_pivots, 0.0).max(axis=1)[None, :]), 0.0)
    wide = rows.dtype == object or centroids.dtype == object
    best, distance = np.full(n, k), np.full(n, None if wide else LONGEST, object if wide else np.int64)
    first = bounds.argmin(axis=1)
    measured = 0
    for turn in (True, False):
        for c in range(k):
            if turn:
                at = np.flatnonzero(first == c)
            else:
                at = np.flatnonzero((first != c) & (bounds[:, c] <= reach))
            if not len(at):
                continue
            d = squared(rows[at], centroids[c])
            measured += len(at)
            if wide:
                better = np.array([best[i] == k or (x, c) < (distance[i], best[i]) for i, x in zip(at.tolist(), d.tolist(), strict=True)], bool)
            else:
                better = (d < distance[at]) | (d == distance[at]) & (c < best[at])
            best[at[better]], distance[at[better]] = c, d[better]
        reach = roots(distance) if n else np.zeros(0)
        reach = reach * (1 + 1e-9) + 1e-9
    return best, distance, measured


def pivot_table(rows: DataFrame, pivots: list[list[int]], size: int) -> DataFrame:
    """The durable table of vec_id, parts and apart (binary: distances to the pivots in float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = as_rows(pivots)
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            x = matrix(parts, size)
            apart = np.stack([roots(squared(x, p)) for p in points], axis=1) if parts else np.empty((0, len(points)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("parts"), pa.array([r.tobytes() for r in apart], pa.binary())], ["vec_id", "parts", "apart"])

    return durable(rows.mapInArrow(run, "vec_id bigint, parts binary, apart binary"), "cluster-pivots")


def measured_batches(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: list[list[int]], size: int) -> Iterator[tuple]:
    points, fixed = as_rows(centroids), as_rows(pivots)
    between = np.stack([roots(squared(points, p)) for p in fixed], axis=1)
    for batch in batches:
        parts = batch.column("parts").to_pylist()
        if parts:
            x = matrix(parts, size)
            apart = np.frombuffer(b"".join(batch.column("apart").to_pylist()), np.float64).reshape(len(parts), -1)
            yield batch, x, *assigned(x, apart, points, between)


def next_centroids(table: DataFrame, centroids: list[list[int]], pivots: list[list[int]], size: int) -> tuple[list[list[int]], int]:
    """Floors of each cluster's means; empty clusters stay. Also the number of distances that were measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, counts, measured = [[0] * size for _ in range(k)], [0] * k, 0
        for _, x, best, _, steps in measured_batches(batches, centroids, pivots, size):
            measured += steps
            for c in np.unique(best).tolist():
                mine = x[best == c]
                counts[c] += len(mine)
                sums[c] = [s + int(v) for s, v in zip(sums[c], mine.sum(axis=0), strict=True)]
        rows = []
        for c in range(k):
            if counts[c]:
                rows += [(c, -1, 0, counts[c])]
                for d, s in enumerate(sums[c]):
                    sign, s, limb = (-1 if s < 0 else 1), abs(s), 0
                    while s or not limb:
                        rows.append((c, d, limb, sign * (s & ((1 << LIMB) - 1))))
                        s, limb = s >> LIMB, limb + 1
        rows.append((-1, -1, 0, measured))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "place", "limb", "value"])

    parts = table.select("parts", "apart").mapInArrow(run, "cluster int, place int, limb int, value bigint")
    total = parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # k times size sums
    counts = {r.cluster: int(r.value) for r in total if r.place < 0}
    sums: dict[tuple[int, int], int] = {}
    for r in total:
        if r.place >= 0:
            sums[r.cluster, r.place] = sums.get((r.cluster, r.place), 0) + (int(r.value) << LIMB * r.limb)
    return [[sums[c, d] // counts[c] for d in range(size)] if c in counts else old for c, old in enumerate(centroids)], counts[-1]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, pivots: int = 8, candidates: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of vectors(vec_id, embedding).

    The first centroids are the k vectors with the least SHA-256 of "seed:vec_id"; pivots come from the first ``candidates``.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size, scale)
    first = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("hash").asc_nulls_last(), "parts").limit(max(k, candidates))
    start = [row_of(bytes(r.parts)) for r in first.select("parts").collect()]
    schema = "vec_id bigint, cluster int, distance bigint"
    if not start:
        nothing = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    fixed, centroids = far_apart(start, pivots), start[:k]
    table = pivot_table(rows, fixed, size)
    for _ in range(rounds):
        centroids, _ = next_centroids(table, centroids, fixed, size)

    def run(centroids: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance, _ in measured_batches(batches, centroids, fixed, size):
            fits = [int(d) if d <= LONGEST else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    final = durable(table.mapInArrow(functools.partial(run, centroids), schema), "cluster-members")
    total = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.isnull("distance")).alias("unknown"))
    by_cluster = {r.cluster: None if r.unknown else int(r.sum) for r in total.collect()}  # a row a cluster
    overall = None if None in by_cluster.values() else sum(by_cluster.values())
    digests = [(c, fitting(by_cluster.get(c)), fitting(overall), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    known = spark.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fitting(value: int | None) -> int | None:
    return value if value is not None and value <= LONGEST else None


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def lloyd_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clusters in SQL: one step a round over the vectors in integers."""
    near = "SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN {0} m) GROUP BY vec_id, x"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(f'm{i}')})")
        steps.append(f"s{i} AS (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY c, i)")
        mean = "(s - ((s % n) + n) % n) // n"
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(q.x, m{i}.x) AS x FROM m{i} LEFT JOIN (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY c) q ON q.c = m{i}.c)")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(f'm{rounds}')})")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,\n"
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON a.c = m.c"
    )
