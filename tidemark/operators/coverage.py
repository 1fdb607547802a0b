"""Coverage of streams: gaps, sequence loss, books, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import HOUR_NS
from tidemark.operators import intervals
from tidemark.operators.scan import BLOCK_HOURS, BLOCK_OFFSETS, neighbours, prefix


def candle_gaps(bars: DataFrame, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """H1: [gap_start, gap_end) between neighbours; an open candle's own interval is part of the gap behind it."""
    rows = neighbours(bars.select("series", "start_ns", "finalized"), ["series"], "start_ns", span or BLOCK_HOURS * interval, behind={"gap_end": "start_ns"})
    begin = F.when(F.col("finalized"), F.col("start_ns") + interval).otherwise(F.col("start_ns"))
    return rows.select("series", begin.alias("gap_start"), "gap_end").where("gap_end > gap_start")


def sequence_gaps(rows: DataFrame, span: int = BLOCK_OFFSETS) -> DataFrame:
    """H2: missing sequence numbers in (stream, session, seq) by arrival (offset); the maximum restarts with a session."""
    rows = prefix(rows, ["stream", "session"], "offset", span, {"_high": (F.max, F.col("seq"))}, inclusive=False)
    return rows.where(F.col("seq") > F.col("_high") + 1).select("stream", "session", (F.col("_high") + 1).alias("first_missing"), (F.col("seq") - 1).alias("last_missing"), "offset")


def book_validity(rows: DataFrame, span: int = BLOCK_OFFSETS) -> DataFrame:
    """H3: (stream, offset, seq, is_snapshot) with valid, and loss on the first bad delta behind a snapshot.

    A book is valid while the last snapshot lies behind the last bad delta; both are running maxima of offsets.
    """
    names = rows.columns
    rows = neighbours(rows, ["stream"], "offset", span, {"_seq": "seq"})
    bad = ~F.coalesce(F.col("is_snapshot") | (F.col("seq") == F.col("_seq") + 1), F.lit(False))
    rows = rows.withColumns({"_snap_at": F.when(F.col("is_snapshot"), F.col("offset")), "_bad_at": F.when(bad, F.col("offset"))})
    rows = prefix(rows, ["stream"], "offset", span, {"_snap": (F.max, F.col("_snap_at")), "_broken": (F.max, F.col("_bad_at"))}, inclusive=False)
    was = F.coalesce(F.col("_snap") > F.coalesce("_broken", F.lit(-1 << 62)), F.lit(False))
    now = F.col("_snap_at").isNotNull() | (was & F.col("_bad_at").isNull())
    return rows.select(*names, now.alias("valid"), (was & ~now).alias("loss"))


def overlapping(spans: DataFrame, claims: DataFrame, unit: int = HOUR_NS) -> DataFrame:
    """C4: spans x claims of a series that overlap, by dyadic pieces: a claim of ten years costs tens of rows."""
    return intervals.overlapping(spans, claims, ["series"], unit)


def coverage_status(spans: DataFrame, claims: DataFrame) -> DataFrame:
    """H5: the worst unresolved status of overlapping claims, else complete if complete claims tile the span, else unknown."""
    return status_of(spans, overlapping(spans, claims))


def status_of(spans: DataFrame, both: DataFrame) -> DataFrame:
    """H5 from the pairs that overlap, of whatever join found them."""
    by = W.partitionBy("series", "span_start", "span_end").orderBy("claim_start", "claim_end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("claim_end").over(by), F.col("span_start"))
    rows = both.withColumn("_hole", F.col("claim_start") > reach)
    bad = {s: F.bool_or(F.col("status") == s) for s in ("unrecoverable", "unknown", "pending")}
    out = rows.groupBy("series", "span_start", "span_end").agg(F.bool_or("_hole").alias("hole"), F.max("claim_end").alias("reach"), *[c.alias(s) for s, c in bad.items()])
    status = F.when(F.col("unrecoverable"), "unrecoverable").when(F.col("unknown"), "unknown").when(F.col("pending"), "pending").when(~F.col("hole") & (F.col("reach") >= F.col("span_end")), "complete").otherwise("unknown")
    out = spans.join(out, ["series", "span_start", "span_end"], "left")
    return out.select("series", "span_start", "span_end", F.coalesce(status, F.lit("unknown")).alias("status"))


def repair(expected: DataFrame, proven: DataFrame, exhausted: bool) -> DataFrame:
    """H6: complete, pending or unknown for each (series, gap_start, gap_end) by the hours proven in it."""
    names = ["series", "gap_start", "gap_end"]
    hours = proven.select("series", "start_ns").distinct()
    hit = intervals.points_within(hours, expected.select(*names).distinct(), ["series"], "start_ns", "gap_start", "gap_end")
    on_grid = F.pmod(F.col("start_ns") - F.col("gap_start"), F.lit(HOUR_NS)) == 0
    found = hit.where(on_grid).groupBy(*names).agg(F.count("*").alias("proven"))
    size = F.expr(f"(gap_end - gap_start + {HOUR_NS - 1}) div {HOUR_NS}")
    out = expected.select(*names).distinct().join(found, names, "left").select(*names, size.alias("expected"), F.coalesce("proven", F.lit(0)).alias("proven"))
    return out.withColumn("state", F.when(F.col("expected") == F.col("proven"), "complete").when(F.lit(exhausted), "unknown").otherwise("pending"))


def admission(page: DataFrame, known: DataFrame, start_ns: int, before_ns: int) -> DataFrame:
    """H7: what to do with each row of a backfill page."""
    k = known.select("series", "start_ns", F.col("close").alias("known_close"))
    rows = page.join(k, ["series", "start_ns"], "left")
    act = F.when(F.col("close").isNull() | (F.col("close") < 0), "malformed").when((F.col("start_ns") < start_ns) | (F.col("start_ns") >= before_ns), "outside").when(F.col("known_close").isNull(), "admit").when(F.col("known_close") == F.col("close"), "duplicate").otherwise("conflict")
    return rows.withColumn("action", act).drop("known_close")


def checkpoint(bars: DataFrame, interval: int = HOUR_NS) -> DataFrame:
    """H8: the end of final bars, held back by the first gap."""
    gaps = candle_gaps(bars, interval).groupBy("series").agg(F.min("gap_start").alias("unresolved"))
    ends = bars.where("finalized").groupBy("series").agg(F.max(F.col("start_ns") + interval).alias("final_end"))
    return ends.join(gaps, "series", "left").select("series", F.least("final_end", F.coalesce("unresolved", "final_end")).alias("checkpoint_ns"))


def restarts(rows: DataFrame) -> DataFrame:
    """H9: unknown spans between the last message of a session and the first of the next (stream, session, ns)."""
    ends = rows.groupBy("stream", "session").agg(F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))
    w = W.partitionBy("stream").orderBy("first_ns", "session")
    return ends.select("stream", "session", F.col("last_ns").alias("gap_start"), F.lead("first_ns").over(w).alias("gap_end")).withColumn("status", F.lit("unknown"))


def freshness(ticks: DataFrame, now_ns: int, limit_ns: int) -> DataFrame:
    """Age of each stream's last message and whether it is stale at ``now_ns``."""
    out = ticks.groupBy("series").agg(F.max("ns").alias("last_ns"), F.count("*").alias("received"))
    return out.withColumn("age_ns", now_ns - F.col("last_ns")).withColumn("stale", F.col("age_ns") > limit_ns)


def united(*sources: DataFrame) -> DataFrame:
    """Claims (series, claim_start, claim_end, status) of several sources: overlaps stay, equal claims count once."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out.distinct()
