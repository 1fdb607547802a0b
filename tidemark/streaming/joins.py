"""Interval joins of two streams (C4, H5, H9): spans and claims with watermarks on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import unit_of


def overlapping(spans: DataFrame, claims: DataFrame, keys: list[str], longest_span: int, longest_claim: int, lateness: str = "0 seconds") -> DataFrame:
    """spans(span_start, span_end), each with the claims(claim_start, claim_end) of its key that overlap, in ns.

    Left outer: a span that meets nothing comes out once, when the watermarks have passed all that could meet it. Both sides
    are keyed by key and a stretch as long as the longest span and claim together. A span lies in the stretch of its start, a claim in
    the two or three where such a span may start, so a pair meets once and a key's state is spread. The lengths bound the
    state; an interval that is longer is an error, never a lost row. Empty intervals meet nothing.
    Rows behind the watermark are late and go, as in every join of streams; it begins at 1970, so intervals start after it.
    """
    unit = longest_span + longest_claim
    s = spans.withColumn("span_ts", at(fits("span", longest_span))).withWatermark("span_ts", lateness).withColumn("_stretch", unit_of(F.col("span_start"), unit)).alias("s")
    c = claims.withColumn("claim_ts", at(fits("claim", longest_claim))).withWatermark("claim_ts", lateness)
    c = c.withColumn("_stretch", F.explode(F.sequence(unit_of(F.col("claim_start") - longest_span, unit), unit_of(F.col("claim_end"), unit)))).alias("c")
    same = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in [*keys, "_stretch"]]
    meet = F.expr("span_start < claim_end and claim_start < span_end and span_end > span_start and claim_end > claim_start")
    # what lets the state go; a microsecond each for the parts below it
    near = F.expr(f"claim_ts >= span_ts - interval {longest_claim // 1000 + 1} microseconds and claim_ts <= span_ts + interval {longest_span // 1000 + 1} microseconds")
    on = meet & near
    for k in same:
        on = k & on
    return s.join(c, on, "leftOuter").select("s.*", *[F.col(f"c.{n}") for n in claims.columns if n not in keys]).drop("_stretch", "span_ts")


def at(ns: Column) -> Column:
    return F.timestamp_micros(unit_of(ns, 1000))


def fits(side: str, longest: int) -> Column:
    start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
    return F.when(end - start > longest, F.raise_error(F.lit(f"a {side} is longer than {longest} ns")).cast("bigint")).otherwise(start)
