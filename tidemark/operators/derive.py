"""Time-series derivations (F1 to F12): windows over exact neighbours, nothing filled.

Windows lie inside blocks of time (scan.py), so a series of any length is dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import DAY_NS, HOUR_NS, log_return
from tidemark.operators.scan import BLOCK_HOURS, BLOCK_OFFSETS, grid, haloed, neighbours, prefix


def chained(bars: DataFrame, back: int, ahead: int, interval: int, span: int | None) -> tuple[DataFrame, W]:
    """bars with copies near the borders of blocks, and the window of one block and grid phase.

    A chain of exact neighbours never reaches farther than its number of intervals, so these copies are all it needs.
    """
    rows = haloed(bars, "start_ns", span or BLOCK_HOURS * interval, back * interval, ahead * interval)
    return rows, W.partitionBy("series", "_block", F.pmod("start_ns", F.lit(interval))).orderBy("start_ns")


def lag_label(bars: DataFrame, steps: int = 2, ahead: int = 3, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """close ``steps`` bars back and ``ahead`` bars on, null with a reason unless the chain is whole.

    The label's chain must be final too; the first failure names the reason. Off-grid starts have a phase of
    their own and break no chain.
    """
    rows, w = chained(bars, steps, ahead, interval, span)
    frame = w.rowsBetween(1, ahead)
    nxt = F.collect_list(F.struct("start_ns", "finalized", "close")).over(frame)
    lag = F.lag(F.struct("start_ns", "close"), steps).over(w)
    rows = rows.withColumns({"_next": nxt, "_lag": lag}).where("_own")
    whole_back = F.col("start_ns") - F.col("_lag.start_ns") == steps * interval
    step = F.zip_with(F.sequence(F.lit(1), F.lit(ahead)), "_next", lambda k, x: F.when(x.isNull() | (x["start_ns"] != F.col("start_ns") + k * interval), F.lit("gap-or-missing")).when(~x["finalized"], F.lit("not-finalized")))
    failed = F.get(F.filter(step, lambda x: x.isNotNull()), F.lit(0))
    return rows.select(
        *bars.columns,
        F.when(whole_back, F.col("_lag.close")).alias("lag_close"),
        F.when(~F.coalesce(whole_back, F.lit(False)), "gap-or-missing").alias("lag_reason"),
        F.when(failed.isNull(), F.get("_next", F.lit(ahead - 1))["close"]).alias("label_close"),
        F.when(failed.isNull(), F.col("start_ns") + (ahead + 1) * interval).alias("label_end_ns"),
        failed.alias("label_reason"))


def lineage(bars: DataFrame, ahead: int = 3, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """offsets of the label chain's visited bars; an open bar is listed and ends it, a missing one just ends it."""
    rows, w = chained(bars, 0, ahead, interval, span)
    rows = rows.withColumn("_next", F.collect_list(F.struct("start_ns", "finalized", "offset")).over(w.rowsBetween(1, ahead))).where("_own")
    there = F.filter("_next", lambda x, k: x["start_ns"] == F.col("start_ns") + (k + 1) * interval)
    prefix = F.aggregate(there, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"], F.concat(a["out"], F.array(x["offset"]))).otherwise(a["out"]).alias("out"), (a["on"] & x["finalized"]).alias("on")))["out"]
    return rows.select("series", "start_ns", F.size(prefix).alias("n_visited"), F.concat_ws(",", F.transform(prefix, lambda x: x.cast("string"))).alias("visited"))


def lagged_returns(bars: DataFrame, count: int = 24, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """the last ``count`` log returns as an array, null unless all are contiguous."""
    rows, w = chained(bars, count, 0, interval, span)
    whole = F.col("start_ns") - F.lag("start_ns", count).over(w) == count * interval
    rows = rows.withColumns({"_ret": log_return(F.col("close"), F.lag("close").over(w)), "_whole": whole})
    rows = rows.withColumn("features", F.collect_list("_ret").over(w.rowsBetween(-(count - 1), 0)))
    return rows.where("_own").select(*bars.columns, F.when(F.col("_whole"), F.col("features")).alias("features"))


def dense_hours(bars: DataFrame, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """series, start_ns for every interval between a series' first and last bar."""
    ends = bars.groupBy("series").agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi"))
    return grid(ends, ["series"], interval, span or BLOCK_HOURS * interval)


def gap_counts(bars: DataFrame, lookback: int, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """missing bars in the ``lookback`` intervals before each grid hour, by differences of a running sum."""
    dense = dense_hours(bars, interval, span).join(bars.select("series", "start_ns", F.lit(0).alias("missing")), ["series", "start_ns"], "left")
    span = span or BLOCK_HOURS * interval
    rows = prefix(dense.withColumn("missing", F.coalesce("missing", F.lit(1))), ["series"], "start_ns", span, {"_run": (F.sum, F.col("missing")), "_n": (F.sum, F.lit(1))})
    rows = haloed(rows, "start_ns", span, (lookback + 1) * interval)
    w = W.partitionBy("series", "_block").orderBy("start_ns")
    before, start = F.lag("_run", 1).over(w), F.coalesce(F.lag("_run", lookback + 1).over(w), F.lit(0))
    rows = rows.withColumn("n_missing", F.when(F.col("_n") > lookback, before - start))
    return rows.where("_own").select("series", "start_ns", "n_missing")


def resampled(bars: DataFrame, bucket: int = DAY_NS, interval: int = HOUR_NS) -> DataFrame:
    """complete buckets only: close is the last bar's; a bucket with a missing or open bar has the first such bar's reason."""
    start = F.col("start_ns") - F.pmod("start_ns", F.lit(bucket))
    days = bars.groupBy("series").agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    dense = grid(days.withColumn("hi", F.col("hi") + bucket - interval), ["series"], interval, BLOCK_HOURS * interval)
    rows = dense.join(bars.select("series", "start_ns", "close", "finalized"), ["series", "start_ns"], "left")
    bad = F.when(F.col("finalized").isNull(), "missing").when(~F.col("finalized"), "not-final")
    out = rows.withColumn("_bad", bad).groupBy("series", start.alias("bucket_ns")).agg(F.max_by("close", "start_ns").alias("close"), F.count("_bad").alias("n_bad"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("start_ns"))).alias("reason"))
    return out.select("series", "bucket_ns", F.when(F.col("n_bad") == 0, F.col("close")).alias("close"), "n_bad", "reason")


def history_lengths(bars: DataFrame, most: int = 512, least: int = 2, interval: int = HOUR_NS, span: int | None = None) -> DataFrame:
    """length of the contiguous history that ends at each bar (capped by the feature), null if too short."""
    rows, w = chained(bars, most, 0, interval, span)
    rows = rows.withColumn("_island", F.col("start_ns") - F.row_number().over(w) * interval)
    own = W.partitionBy("series", "_block", F.pmod("start_ns", F.lit(interval)), "_island").orderBy("start_ns")
    rows = rows.withColumns({"_length": F.least(F.row_number().over(own), F.lit(most)), "_sum": F.sum("close").over(own.rowsBetween(-(most - 1), 0))})
    return rows.where("_own").select("series", "start_ns", F.when(F.col("_length") >= least, F.col("_length")).alias("history"), F.round("_sum", 4).alias("history_sum"))


def window_sums(values: DataFrame, length: int) -> DataFrame:
    """F8: sums of ``length`` consecutive days from each day on (series, day, value); null at the end."""
    w = W.partitionBy("series").orderBy("day")
    total, n = F.sum("value").over(w.rowsBetween(0, length - 1)), F.count("*").over(w.rowsBetween(0, length - 1))
    return values.select("series", "day", F.when(n == length, total).alias("total"))


def autocorrelation(values: DataFrame, lags: int) -> DataFrame:
    """series, lag, correlation, significant (above 2 / sqrt(n)) of a daily series by an exact self-join on day."""
    base = values.groupBy("series").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count("*").alias("n"))
    one = values.join(base, "series").select("series", "day", (F.col("value") - F.col("mean")).alias("x"), "var", "n", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    two = values.join(base.select("series", "mean"), "series").select("series", (F.col("day")).alias("day2"), (F.col("value") - F.col("mean")).alias("y"))
    both = one.withColumn("day2", F.col("day") + F.col("lag")).join(two, ["series", "day2"])
    out = both.groupBy("series", "lag").agg((F.sum(F.col("x") * F.col("y")) / F.first("n") / F.first("var")).alias("r"), F.first("n").alias("n"))
    return out.select("series", "lag", F.round("r", 6).alias("r"), (F.abs("r") > 2 / F.sqrt("n")).alias("significant"))


def segments(records: DataFrame, change: list[str], limit: int, span: int = BLOCK_OFFSETS) -> DataFrame:
    """a segment number for each record of a producer: a new one when a column in ``change`` changes or ``limit`` is reached.

    A record's place since the last change follows from two running values; a second scan counts where segments begin.
    """
    rows = neighbours(records, ["producer"], "offset", span, {"_there": "producer", **{f"_last_{c}": c for c in change}})
    changed = F.col("_there").isNull()
    for c in change:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_last_{c}"))
    rows = rows.withColumn("_changed", changed)
    rows = prefix(rows, ["producer"], "offset", span, {"_n": (F.sum, F.lit(1))})
    rows = prefix(rows, ["producer"], "offset", span, {"_since": (F.max, F.when(F.col("_changed"), F.col("_n")))})
    opens = F.pmod(F.col("_n") - F.col("_since"), F.lit(limit)) == 0
    rows = prefix(rows.withColumn("_opens", opens), ["producer"], "offset", span, {"segment": (F.sum, F.col("_opens").cast("int"))})
    return rows.select(*records.columns, F.col("segment").cast("int").alias("segment"))


def first_cases(cases: DataFrame, keys: list[str], order: Column, count: int) -> DataFrame:
    """the first ``count`` cases of each key."""
    return cases.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= count).drop("_n")
