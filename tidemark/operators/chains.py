"""Greedy chains: the first row, the first row behind it that a rule allows, and so on.

A rule gives each row its successor; the successors composed with themselves are jumps of 2, 4, 8 steps. The rows a chain
takes are found by these jumps: with k of them known, the next jump finds k more. So a chain of n rows takes log n rounds of
joins by (key, position), and no row holds a group. Successors themselves come from running minima over blocks (scan.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix
from tidemark.sources.scratch import durable


def next_at_or_after(rows: DataFrame, keys: list[str], order: str, target: str, span: int, value: str) -> DataFrame:
    """rows with ``next``: the least ``value`` of the key's rows whose ``order`` is at or after this row's ``target``."""
    one = rows.select(*keys, (2 * F.col(order) + 1).alias("_at"), F.col(value).alias("_value"), F.lit(None).cast("bigint").alias("_of"))
    two = rows.select(*keys, (2 * F.col(target)).alias("_at"), F.lit(None).cast("bigint").alias("_value"), F.col(value).alias("_of"))
    found = prefix(one.union(two), keys, "_at", 2 * span, {"next": (F.min, F.col("_value"))}, reverse=True)
    return found.where("_of is not null").select(*keys, F.col("_of").alias(value), "next")


def taken(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at) of the rows that each key's chain takes; links(keys, at, next) has each position once, next null at the end."""
    parts = [durable(links.groupBy(*keys).agg(F.min("at").alias("at")), "chain-taken")]
    jumps = links.where("next is not null").select(*keys, "at", "next")
    while True:
        jumps, seen = durable(jumps, "chain-jumps"), Observation()
        have = reduce(DataFrame.union, parts)
        more = have.join(jumps, [*keys, "at"]).select(*keys, F.col("next").alias("at"))
        parts.append(durable(more.observe(seen, F.count(F.lit(1)).alias("n")), "chain-taken"))
        if not seen.get["n"]:
            return have
        further = jumps.select(*keys, F.col("at").alias("_from"), F.col("next").alias("at"))
        jumps = further.join(jumps, [*keys, "at"]).select(*keys, F.col("_from").alias("at"), "next")


def spaced(rows: DataFrame, keys: list[str], order: str, distance: int, span: int) -> DataFrame:
    """(keys, at): greedily chosen positions, each at least ``distance`` behind the one before."""
    at = rows.select(*keys, F.col(order).alias("at")).distinct()
    links = next_at_or_after(at.withColumn("_target", F.col("at") + distance), keys, "at", "_target", span, "at")
    return taken(links, keys)
