"""Targets, baselines, scores and comparison."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import DAY_NS, HOUR_NS, log_return
from tidemark.operators import chains, derive
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.scan import BLOCK_HOURS, haloed, prefix


def as_of(revisions: DataFrame, keys: list[str], known: str, cutoff: Column) -> DataFrame:
    """Of each key the latest revision known at the cutoff, by (known, revision)."""
    rest = [c for c in revisions.columns if c not in keys]
    out = revisions.where(F.col(known) <= cutoff).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(known, "revision")).alias("s"))
    return out.select(*keys, "s.*")


def horizon_pairs(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Each bar with its endpoint ``h`` hours on, all horizons in one pass; end_close is null where it is missing."""
    start = bars.select("series", "start_ns", "close", "finalized", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    start = start.withColumn("end_ns", F.col("start_ns") + F.col("horizon").cast("bigint") * HOUR_NS)
    end = bars.select("series", F.col("start_ns").alias("end_ns"), F.col("close").alias("end_close"), F.col("finalized").alias("end_final"))
    return start.join(end, ["series", "end_ns"], "left")


def horizon_summary(pairs: DataFrame) -> DataFrame:
    """Eligible, missing and invalid endpoints and the sum of differences in cents of each horizon."""
    ok = F.col("end_close").isNotNull() & F.col("finalized") & F.col("end_final")
    cents = F.round((F.col("end_close") - F.col("close")) * 100).cast("bigint")
    return pairs.groupBy("horizon").agg(
        F.count_if(ok).alias("eligible"), F.count_if(F.col("end_close").isNull()).alias("missing"),
        F.count_if(F.col("end_close").isNotNull() & ~ok).alias("invalid"), F.sum(F.when(ok, cents)).alias("cents"))


def partition_of(start: Column, end: Column, splits: list[tuple[str, int, int]]) -> Column:
    """The split that holds the whole decision interval, else null."""
    out = None
    for name, lo, hi in splits:
        inside = (start >= lo) & (end < hi)  # a label that merely touches the boundary is purged
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def point_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Count, MAE, RMSE, bias of (prediction, target)."""
    e = F.col("prediction") - F.col("target")
    return cases.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"))


def return_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, magnitude error, direction accuracy balanced over both signs, ties."""
    p, t = F.col("prediction"), F.col("target")
    up, down = F.avg(F.when(t > 0, (p > 0).cast("double"))), F.avg(F.when(t < 0, (p < 0).cast("double")))
    return cases.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(p - t)), 8).alias("mae"), F.round(F.avg(F.abs(F.abs(p) - F.abs(t))), 8).alias("magnitude_mae"),
        F.round((up + down) / 2, 8).alias("balanced_accuracy"), F.count_if(p == 0).alias("prediction_ties"), F.count_if(t == 0).alias("target_ties"),
        F.count_if(t > 0).alias("positive"), F.count_if(t < 0).alias("negative"))


def probability_scores(cases: DataFrame, keys: list[str]) -> DataFrame:
    """E5: pinball losses, 80 % coverage and width, Brier and log score of (q10, q50, q90, p_up, target)."""
    t, up = F.col("target"), (F.col("target") > 0).cast("double")
    pin = lambda q, c: F.avg(F.greatest(q * (t - F.col(c)), (q - 1) * (t - F.col(c))))
    log = -(up * F.ln("p_up") + (1 - up) * F.ln(1 - F.col("p_up")))
    return cases.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(pin(0.1, "q10"), 8).alias("pinball_10"), F.round(pin(0.5, "q50"), 8).alias("pinball_50"), F.round(pin(0.9, "q90"), 8).alias("pinball_90"),
        F.round(F.avg(((t >= F.col("q10")) & (t <= F.col("q90"))).cast("double")), 8).alias("coverage_80"), F.round(F.avg(F.col("q90") - F.col("q10")), 8).alias("width_80"),
        F.round(F.avg((F.col("p_up") - up) * (F.col("p_up") - up)), 8).alias("brier"), F.round(F.avg(log), 8).alias("log_score"))


def reliability(cases: DataFrame) -> DataFrame:
    """E5: ten bins of p_up with counts, mean forecast and frequency."""
    return cases.groupBy(F.least(F.lit(9), F.floor(F.col("p_up") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_up"), 8).alias("mean_p"), F.round(F.avg((F.col("target") > 0).cast("double")), 8).alias("frequency"))


def daily_losses(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Loss sums a UTC day."""
    e = F.col("prediction") - F.col("target")
    return cases.groupBy(*keys, F.floor(F.col("start_ns") / F.lit(DAY_NS)).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(e)), 6).alias("abs_loss"), F.round(F.sum(e * e), 6).alias("sq_loss"))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Linear (n - 1) q quantiles, exact for groups of any size."""
    return exact_quantiles(rows, keys, value, at).select(*keys, *[F.round(name, 8).alias(name) for name in at])


def standardizer(train: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population scale; a constant series has scale 1."""
    return train.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def blocks(rows: DataFrame, keys: list[str], duration_ns: int) -> DataFrame:
    """Greedy count of origins that lie at least ``duration_ns`` apart."""
    chosen = chains.spaced(rows, keys, "start_ns", duration_ns, BLOCK_HOURS * HOUR_NS)
    return chosen.groupBy(*keys).agg(F.count("*").cast("int").alias("blocks"))


def next_faults(bars: DataFrame, span: int | None = None) -> DataFrame:
    """series, start_ns of each grid hour, close, lo (the series' first hour), and ``fault``: the first missing or open hour from here on."""
    rows = derive.dense_hours(bars, HOUR_NS, span).join(bars.select("series", "start_ns", "close", "finalized"), ["series", "start_ns"], "left")
    bad = F.when(F.col("finalized").isNull(), "missing").when(~F.col("finalized"), "not-final")
    at = F.when(bad.isNotNull(), F.struct("start_ns", bad.alias("bad")))
    rows = prefix(rows.withColumn("_at", at), ["series"], "start_ns", span or BLOCK_HOURS * HOUR_NS, {"fault": (F.min, F.col("_at"))}, reverse=True)
    lo = bars.groupBy("series").agg(F.min("start_ns").alias("lo"))  # a row a series
    return rows.join(lo, "series").select("series", "start_ns", "close", "lo", "fault")


def origins(bars: DataFrame, lookback: int, span: int | None = None) -> DataFrame:
    """Origins on the hour grid; the first missing or open hour of the lookback is the reason against one.

    That hour is the next fault as seen from the lookback's first hour, so a lookback of any length costs one shift.
    """
    rows = next_faults(bars, span)
    from_first = rows.select("series", (F.col("start_ns") + (lookback - 1) * HOUR_NS).alias("start_ns"), "fault")
    out = rows.drop("fault").join(from_first, ["series", "start_ns"], "left")
    boundary = F.col("start_ns") - (lookback - 1) * HOUR_NS < F.col("lo")
    reason = F.when(boundary, "missing-history-boundary").when(F.col("fault.start_ns") <= F.col("start_ns"), F.col("fault.bad"))
    return out.select("series", (F.col("start_ns") + HOUR_NS).alias("origin_ns"), "close", reason.alias("reason"))


def outcomes(bars: DataFrame, origin: DataFrame, horizon: int) -> DataFrame:
    """Log return over ``horizon`` hours for eligible origins whose every hour is there and final."""
    fit = bars.where("finalized").select("series", F.col("start_ns"), F.col("close").alias("end_close"))
    fit = haloed(fit, "start_ns", BLOCK_HOURS * HOUR_NS, (horizon - 1) * HOUR_NS)
    back = F.lag("start_ns", horizon - 1).over(W.partitionBy("series", "_block").orderBy("start_ns")) if horizon > 1 else F.col("start_ns")
    whole = fit.withColumn("_back", back).where(F.col("_own") & (F.col("start_ns") - F.col("_back") == (horizon - 1) * HOUR_NS)).select("series", "start_ns", "end_close")
    good = origin.where("reason is null").withColumn("start_ns", F.col("origin_ns") + (horizon - 1) * HOUR_NS)
    out = good.join(whole, ["series", "start_ns"], "left")
    return out.select("series", "origin_ns", F.round(log_return(F.col("end_close"), F.col("close")), 8).alias("target"), F.when(F.col("end_close").isNull(), "outcome-missing").alias("reason"))


def ridge_one(rows: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """J12 for one feature: ridge on the standardised feature, summed Gram, unpenalised intercept."""
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("sx"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"))
    weight = F.col("n") * F.col("cxy") / F.col("sx") / (F.col("n") * F.col("vx") / F.col("sx") / F.col("sx") + alpha)
    return m.select(*keys, "n", F.round(weight, 8).alias("weight"), F.round("my", 8).alias("intercept"))


def holm(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Step-down over tests(name, p)."""
    total = F.count("*").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy("p", "name"))  # a declared family of tests: a few rows
    rows = tests.withColumn("_limit", level / (total - rank + 1)).withColumn("rank", rank)
    return rows.select("name", "p", "rank", F.bool_and(F.col("p") <= F.col("_limit")).over(W.orderBy("rank")).alias("rejected"))


def draws(spark: SparkSession, days: int, length: int, count: int = 2000, seed: int = 42) -> DataFrame:
    """(draw, start, take): moving blocks that sum to ``days`` days, the last one a tail that may start at any day
    from which it fits; about count * days / length rows."""
    rng = random.Random(seed)
    length = min(length, days)
    rows = []
    for draw in range(count):
        left = days
        while left > 0:
            take = min(length, left)
            rows.append((draw, rng.randrange(days - take + 1), take))
            left -= length
    return spark.createDataFrame(rows, "draw int, start int, take int")


def bootstrap(daily: DataFrame, table: DataFrame, length: int) -> DataFrame:
    """Resampled loss sums of (series, day index, loss): F8 window sums joined with the draw table."""
    w = W.partitionBy("series").orderBy("day")
    sums = daily.select("series", "day", *[F.sum("loss").over(w.rowsBetween(0, k - 1)).alias(f"s{k}") for k in range(1, length + 1)])
    pick = F.element_at(F.array(*[f"s{k}" for k in range(1, length + 1)]), F.col("take"))
    joined = sums.join(table, F.col("day") == F.col("start"))
    return joined.groupBy("series", "draw").agg(F.round(F.sum(pick), 6).alias("loss"))
