"""Scalar rules of the market data model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
#: Interval codes of the venue's kline messages, fixed values.
INTERVAL_MINUTES = {"1": 1, "3": 3, "5": 5, "15": 15, "30": 30, "60": 60, "120": 120, "240": 240, "360": 360, "720": 720, "D": 1440, "W": 10080}
HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS


def nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def canonical_decimal(text: Column) -> Column:
    """Decimal text without exponent, needless zeros or a plus; null for anything else. Minus zero is 0."""
    body = F.regexp_replace(text, r"^([+-]?)0+(?=[0-9])", "$1")
    body = F.regexp_replace(F.regexp_replace(body, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    body = F.regexp_replace(body, r"^\+", "")
    body = F.when(body.rlike(r"^-0*$"), "0").otherwise(body)
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), body)


def semantic_revision(*fields: Column) -> Column:
    """sha256: of the JSON array of the value fields as strings."""
    quoted = [F.concat(F.lit('"'), f.cast("string"), F.lit('"')) for f in fields]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256))


def ohlc_consistent(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.coalesce((low >= 0) & (low <= F.least(o, c)) & (F.greatest(o, c) <= h), F.lit(False))


def source_ns(value: Column, unit: Column) -> Column:
    out = F.when(unit == "s", value * NANOS["s"])
    for name in ("ms", "us", "ns"):
        out = out.when(unit == name, value * NANOS[name])
    return out


def is_identifier(text: Column, most: int = 128) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$") & (F.char_length(text) <= most), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def time_interval(wall: Column, status: Column, offset: Column, uncertainty: Column, age: Column, budget_ns: int, drift_ppb: int) -> Column:
    """struct(lo, hi) of wall -+ uncertainty, or null where the clock evidence is unhealthy or too weak."""
    drifted = F.ceil(age.cast("decimal(38,0)") * drift_ppb / 1_000_000_000).cast("bigint")
    fit = (status == "healthy") & (uncertainty <= budget_ns) & (uncertainty >= F.abs(offset) + drifted)
    return F.when(fit, F.struct((wall - uncertainty).alias("lo"), (wall + uncertainty).alias("hi")))


def observed_by(observation: Column, cutoff: Column) -> Column:
    """The latest plausible observation is not after the earliest plausible cutoff; unknown clocks give false."""
    return F.coalesce(observation["hi"] <= cutoff["lo"], F.lit(False))


def is_final(sample: Column, boundary_ns: Column) -> Column:
    return F.coalesce(sample["lo"] > boundary_ns, F.lit(False))


def timeliness(before: Column, after: Column, session_before: Column, session_after: Column, deadline: Column) -> Column:
    return (
        F.when(session_before != session_after, "clock-discontinuity").when(before.isNull() | after.isNull(), "unknown")
        .when(after["hi"] <= deadline, "on-time").when(before["lo"] > deadline, "late").otherwise("uncertain")
    )


def utc_date(ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(ns / F.lit(1_000_000_000)).cast("bigint")), "yyyy-MM-dd")


def fits_decimal(text: Column, precision: int = 38, scale: int = 18) -> Column:
    """The text's digits fit decimal(precision, scale) without rounding."""
    whole = F.char_length(F.regexp_extract(text, r"^-?0*([0-9]*)", 1))
    part = F.char_length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1))
    return F.coalesce(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$") & (whole <= precision - scale) & (part <= scale), F.lit(False))


def log_return(later: Column, earlier: Column) -> Column:
    return F.when((later > 0) & (earlier > 0), F.ln(later) - F.ln(earlier))
