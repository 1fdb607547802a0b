"""Interval joins by dyadic pieces (C4, H5, H6).

Two intervals overlap where one begins in the other, which is so in exactly one of two ways unless they begin together. An
interval is cut into aligned pieces of 1, 2, 4, ... units, at most two a size, so an interval of n units has about 2 log n; a
point lies in one piece of each size. Points meet intervals in an equi-join by (key, size, piece), once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR_NS

#: Sizes go up to 2^TOP units; a longer interval has several pieces of that size.
TOP = 24


def unit_of(at: Column, unit: int) -> Column:
    """Which unit a position lies in, in whole numbers (a quotient of two longs would be rounded)."""
    return ((at - F.pmod(at, F.lit(unit))).cast("decimal(38,0)") / F.lit(unit).cast("decimal(38,0)")).cast("bigint") if unit > 1 else at


def pieces(start: Column, end: Column, unit: int) -> tuple[Column, Column]:
    """For a column _bounds, and then from it the pieces (size, piece) of [start, end), at units that it touches."""
    bounds = F.array(F.struct(unit_of(start, unit).alias("low"), (unit_of(end - 1, unit) + 1).alias("high")))
    # by names, as shifts by a lambda's variable have no function of their own in Python
    size = "named_struct('size', k, 'piece', {})"
    left = f"if(-shiftright(-x.low, k) < shiftright(x.high, k) and -shiftright(-x.low, k) % 2 <> 0, array({size.format('-shiftright(-x.low, k)')}), array())"
    right = f"if(-shiftright(-x.low, k) < shiftright(x.high, k) and shiftright(x.high, k) % 2 <> 0, array({size.format('shiftright(x.high, k) - 1')}), array())"
    top = f"if(-shiftright(-x.low, {TOP}) < shiftright(x.high, {TOP}), transform(sequence(-shiftright(-x.low, {TOP}), greatest(-shiftright(-x.low, {TOP}), shiftright(x.high, {TOP}) - 1)), p -> named_struct('size', {TOP}, 'piece', p)), array())"
    found = F.expr(f"flatten(transform(_bounds, x -> concat(flatten(transform(sequence(0, {TOP - 1}), k -> concat({left}, {right}))), {top})))")
    return bounds, found


def cut(rows: DataFrame, start: str, end: str, unit: int) -> DataFrame:
    """rows with one row a piece (size, piece)."""
    bounds, found = pieces(F.col(start), F.col(end), unit)
    parts = rows.where(F.col(end) > F.col(start)).withColumn("_bounds", bounds).withColumn("_p", F.explode(found))
    return parts.select(*rows.columns, "_p.size", "_p.piece")


def placed(rows: DataFrame, at: str, sizes: DataFrame, unit: int) -> DataFrame:
    """rows with the piece that their position lies in, for each size in use."""
    place = unit_of(F.col(at), unit)
    every = rows.withColumn("_place", place).join(F.broadcast(sizes), F.lit(True))
    return every.withColumn("piece", F.expr("shiftright(_place, size)")).drop("_place")


def points_within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, unit: int = HOUR_NS) -> DataFrame:
    """Each point with each span of its key that holds it: start <= at < end."""
    parts = cut(spans, start, end, unit)
    sizes = parts.select("size").distinct()  # at most TOP + 1 rows
    both = placed(points, at, sizes, unit).join(parts, [*keys, "size", "piece"])
    return both.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("size", "piece")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], unit: int = HOUR_NS) -> DataFrame:
    """Pairs of left(span_start, span_end) and right(claim_start, claim_end) of a key that overlap, each once.

    The unit is the step of the grid; intervals need not lie on it. Rows where the end is not behind the start meet nothing.
    """
    left, right = left.where("span_end > span_start"), right.where("claim_end > claim_start")
    one = points_within(left, right, keys, "span_start", "claim_start", "claim_end", unit)
    two = points_within(right, left, keys, "claim_start", "span_start", "span_end", unit).where("claim_start > span_start")
    return one.unionByName(two)
