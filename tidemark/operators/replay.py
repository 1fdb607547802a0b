"""Eligibility, replay cases, frozen predictions and paired comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import HOUR_NS


def structural_reason(origin: Column, split_start: Column, split_end: Column, embargo_ns: int, first_start: Column, lookback_ns: int, horizon_ns: Column) -> Column:
    """The embargo at the split's start, then the history, then the end of the label, by this precedence; null if none."""
    return (
        F.when(origin < split_start + embargo_ns, "embargo").when(origin - lookback_ns < first_start, "missing-history-boundary")
        .when(origin + horizon_ns >= split_end, "split-endpoint")
    )


def candidates(bars: DataFrame, splits: list[tuple[str, int, int]], cadence_ns: int = HOUR_NS) -> DataFrame:
    """Series, split, split_start, split_end, origin_ns, first_start: every origin of the cadence in every split."""
    spark = bars.sparkSession
    ends = bars.groupBy("series").agg(F.min("start_ns").alias("first_start"))
    table = spark.createDataFrame(splits, "split string, split_start bigint, split_end bigint")  # a row a split
    first = F.expr(f"(split_start + {cadence_ns - 1}) div {cadence_ns} * {cadence_ns}")
    return ends.crossJoin(F.broadcast(table)).withColumn("origin_ns", F.explode(F.sequence(first, F.col("split_end") - 1, F.lit(cadence_ns))))


def feasibility(rows: DataFrame, origins: DataFrame, outcomes: DataFrame, embargo_ns: int, lookback_ns: int, horizon_ns: int) -> DataFrame:
    """Candidates with ``state``: the structural reason, else the origin's, else the outcome's, else matured."""
    reason = structural_reason(F.col("origin_ns"), F.col("split_start"), F.col("split_end"), embargo_ns, F.col("first_start"), lookback_ns, F.lit(horizon_ns))
    known = origins.select("series", "origin_ns", F.coalesce("reason", F.lit("")).alias("_origin"))
    label = outcomes.select("series", "origin_ns", F.coalesce("reason", F.lit("")).alias("_label"))
    rows = rows.join(known, ["series", "origin_ns"], "left").join(label, ["series", "origin_ns"], "left")
    state = F.coalesce(reason, F.when(F.col("_origin").isNull(), "missing").when(F.col("_origin") != "", F.col("_origin")), F.when(F.coalesce("_label", F.lit("outcome-missing")) != "", "outcome-missing"), F.lit("matured"))
    return rows.withColumn("state", state).drop("_origin", "_label")


def eligibility(bars: DataFrame, base_ns: int, start_ns: int, end_ns: int, horizon_hours: int, cutoff_ns: int, training: bool, lags: int, embargo_ns: int, delay_ns: int, fit_cutoff_ns: int) -> DataFrame:
    """origin_ns and state of every common origin in [start, end): selected, or why not, by bounds and missing hours only.

    An hour that any series misses spoils the origins whose features or label cover it. Missing hours are few, so they are
    spread over these origins and joined, instead of prefix sums over whole series.
    """
    spark = bars.sparkSession
    every = bars.agg(F.count_distinct("series").alias("every"))
    hours = spark.range(1).select(F.explode(F.sequence(F.lit(base_ns), F.lit(end_ns + horizon_hours * HOUR_NS), F.lit(HOUR_NS))).alias("start_ns"))
    have = bars.groupBy("start_ns").agg(F.count_distinct("series").alias("have"))
    missing = hours.join(have, "start_ns", "left").crossJoin(F.broadcast(every)).where(F.coalesce("have", F.lit(0)) < F.col("every"))
    # the bar that ends at the origin is its last feature hour; the label takes the hours behind
    spoiled = missing.select(F.explode(F.sequence(F.col("start_ns") + HOUR_NS - horizon_hours * HOUR_NS, F.col("start_ns") + HOUR_NS + lags * HOUR_NS, F.lit(HOUR_NS))).alias("origin_ns")).distinct()
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start_ns), F.lit(end_ns - 1), F.lit(HOUR_NS))).alias("origin_ns")).join(spoiled.withColumn("_bad", F.lit(True)), "origin_ns", "left")
    o = F.col("origin_ns")
    place = F.expr(f"(origin_ns - {base_ns}) div {HOUR_NS} - 1")
    state = F.when(o + horizon_hours * HOUR_NS + delay_ns >= cutoff_ns, "immature-or-boundary-label").when(place < lags, "missing-feature-history")
    if not training:
        state = state.when(o - lags * HOUR_NS <= fit_cutoff_ns + embargo_ns, "purge-or-embargo")
    return rows.select("origin_ns", state.when(F.col("_bad"), "incomplete-common-pair").otherwise("selected").alias("state"))


def replay_cases(rows: DataFrame, splits: list[tuple[str, int, int]], delay_ns: int, radius_ns: int) -> DataFrame:
    """rows(series, start_ns, close, finalized, available_ns or null, covered) in one lag and one label step.

    part and reason of every row: ``case`` or the first thing against it, features before the label; quality and
    availability may each give a reason, then both are listed.
    """
    w = W.partitionBy("series").orderBy("start_ns")
    near = lambda c, k: F.when(F.lag("start_ns", k).over(w) == F.col("start_ns") - k * HOUR_NS, F.lag(c, k).over(w)) if k > 0 else F.when(F.lead("start_ns", -k).over(w) == F.col("start_ns") - k * HOUR_NS, F.lead(c, -k).over(w))
    for name, k in (("lag", 1), ("label", -1)):
        rows = rows.withColumns({f"{name}_final": near("finalized", k), f"{name}_available": near("available_ns", k), f"{name}_covered": near("covered", k)})
    origin = F.col("start_ns") + HOUR_NS + delay_ns
    part = boundary = None
    for name, lo, hi in splits:
        inside = (origin - radius_ns >= lo) & (origin + radius_ns < hi)
        part = F.when(inside, name) if part is None else part.when(inside, name)
        boundary = F.when(inside, F.lit(hi)) if boundary is None else boundary.when(inside, F.lit(hi))
    rows = rows.withColumns({"part": part, "boundary": boundary})
    quality = [F.col("available_ns").isNull() | F.col("lag_available").isNull(), ~F.col("covered") | ~F.col("lag_covered")]
    late = quality[0] | (F.greatest("available_ns", "lag_available") > origin - radius_ns)
    listed = F.array_join(F.filter(F.array(F.when(quality[1], "coverage"), F.when(late, "feature-unavailable"), F.when(quality[0], "time-quality")), lambda x: x.isNotNull()), ",")
    end = F.col("start_ns") + 2 * HOUR_NS
    reason = (
        F.when(F.col("part").isNull(), "outside-or-crossing-split").when(~F.col("finalized"), "not-finalized").when(F.col("lag_final").isNull(), "lag-gap-or-missing").when(~F.col("lag_final"), "lag-not-finalized")
        .when(listed != "", listed).when(F.col("label_final").isNotNull() & F.col("label_final") & (end <= origin + radius_ns), "label-not-future").when(F.col("label_final").isNotNull() & F.col("label_final") & (end >= F.col("boundary")), "label-purged")
        .when(F.col("label_final").isNull(), "label-gap-or-missing").when(~F.col("label_final"), "label-not-finalized")
        .when(F.col("label_available").isNull() | (F.col("label_available") > F.col("boundary") - 1 - radius_ns), "label-availability-purged").when(~F.col("label_covered"), "label-coverage").otherwise("case")
    )
    return rows.select("series", "start_ns", "close", "part", reason.alias("reason"))


def ridge(rows: DataFrame, keys: list[str], lags: int, alpha: float = 1.0) -> DataFrame:
    """(keys, features array of ``lags``, target) to intercept, means, scales, coefficients of each group.

    The standardised Gram matrix is summed over exploded products (combined before the shuffle), so a group of any
    length gives lags * (lags + 1) / 2 rows; only these are solved together, unpenalised intercept, alpha on the rest.
    """
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("target").alias("intercept"), *[F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(lags)], *[F.coalesce(F.nullif(F.stddev_pop(F.get("features", F.lit(i))), F.lit(0.0)), F.lit(1.0)).alias(f"s{i}") for i in range(lags)])
    first = first.select(*keys, "n", "intercept", F.array(*[f"m{i}" for i in range(lags)]).alias("means"), F.array(*[f"s{i}" for i in range(lags)]).alias("scales"))
    x = F.zip_with(F.zip_with("features", "means", lambda a, m: a - m), "scales", lambda a, s: a / s)
    rows = rows.join(first, keys).select(*keys, x.alias("x"), (F.col("target") - F.col("intercept")).alias("y"))
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("x", i) * F.get("x", j)).alias("v")))))
    right = F.transform("x", lambda a, i: F.struct(i.alias("i"), F.lit(-1).alias("j"), (a * F.col("y")).alias("v")))
    sums = rows.select(*keys, F.explode(F.concat(each, right)).alias("p")).groupBy(*keys, "p.i", "p.j").agg(F.sum("p.v").alias("v"))

    def solved(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        gram, rhs = np.zeros((lags, lags)), np.zeros(lags)
        for i, j, v in zip(part["i"], part["j"], part["v"], strict=True):
            if j < 0:
                rhs[i] = v
            else:
                gram[i, j] = gram[j, i] = v
        return pd.DataFrame([[*key, np.linalg.solve(gram + alpha * np.eye(lags), rhs).tolist()]], columns=[*keys, "coefficients"])

    types = dict(rows.dtypes)
    found = sums.groupBy(*keys).applyInPandas(solved, ", ".join(f"{k} {types[k]}" for k in keys) + ", coefficients array<double>")
    return first.join(found, keys)


def predicted(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the prediction of frozen parameters (intercept, means, scales, coefficients)."""
    z = F.zip_with(F.zip_with("features", "means", lambda a, m: a - m), "scales", lambda a, s: a / s)
    terms = F.zip_with(z, "coefficients", lambda a, c: a * c)
    both = rows.join(model.select(*keys, "intercept", "means", "scales", "coefficients"), keys, "left")
    return both.withColumn("prediction", F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).drop("intercept", "means", "scales", "coefficients")


def verified(again: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """State of each key: same, differs, only-stored or only-recomputed, by the stored prediction."""
    both = again.select(*keys, F.col("prediction").alias("_now")).join(stored.select(*keys, F.col("prediction").alias("_then")), keys, "full_outer")
    state = F.when(F.col("_now").isNull(), "only-stored").when(F.col("_then").isNull(), "only-recomputed").when(F.abs(F.col("_now") - F.col("_then")) <= tolerance, "same").otherwise("differs")
    return both.select(*keys, state.alias("state"))


def pair_identity(cases: DataFrame, group: list[str], algorithm: str, key: Column) -> DataFrame:
    """Of each group whether all algorithms scored the same cases: equal counts and equal commutative digests."""
    part = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    each = cases.groupBy(*group, algorithm).agg(F.count("*").alias("_n"), F.sum(part).alias("_h"))
    return each.groupBy(*group).agg(F.count("*").alias("algorithms"), F.max("_n").alias("cases"), ((F.min("_n") == F.max("_n")) & (F.min("_h") == F.max("_h"))).alias("same"))


def window_sums(daily: DataFrame, keys: list[str], values: list[str], lengths: list[int]) -> DataFrame:
    """F8: daily(keys, day 0..n-1, values) with <value>_<length>: sums of ``length`` days from each day on."""
    w = W.partitionBy(*keys).orderBy("day")
    return daily.select(*keys, "day", *[F.sum(v).over(w.rowsBetween(0, k - 1)).alias(f"{v}_{k}") for v in values for k in lengths])


def resampled(daily: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys, draw and the values' sums over the blocks of each draw(draw, start, take); numerators and counts alike.

    Every draw serves all assets and algorithms, so their differences are paired.
    """
    lengths = sorted(r.take for r in table.select("take").distinct().collect())  # a block and a tail
    sums = window_sums(daily, keys, values, lengths)
    pick = lambda v: F.coalesce(*[F.when(F.col("take") == k, F.col(f"{v}_{k}")) for k in lengths])
    joined = sums.join(table, F.col("day") == F.col("start"))
    return joined.groupBy(*keys, "draw").agg(*[F.sum(pick(v)).alias(v) for v in values])


def skills(draws: DataFrame, whole: DataFrame, family: int) -> DataFrame:
    """draws(algorithm, asset, draw, loss, n) and whole(algorithm, asset, loss, n) to skill, lower bound and p.

    Assets weigh alike. The champion is the least (mean error, name). p is one-sided, centred under zero skill; the
    lower bound is at 0.025 divided by the family; a claim needs more than 2 % there.
    """
    mean = lambda rows, by: rows.groupBy(*by).agg(F.avg(F.try_divide("loss", "n")).alias("mae"))
    total = mean(whole, ["algorithm"])
    best = total.agg(F.min_by(F.struct("algorithm", "mae"), F.struct("mae", "algorithm")).alias("b")).select(F.col("b.algorithm").alias("champion"), F.col("b.mae").alias("best"))
    total = total.crossJoin(F.broadcast(best)).withColumn("skill", F.when(F.col("best") != 0, 1 - F.col("mae") / F.col("best")).otherwise(0.0))
    each = mean(draws, ["algorithm", "draw"])
    champion = each.join(F.broadcast(best), F.col("algorithm") == F.col("champion")).select("draw", F.col("mae").alias("_c"))
    each = each.join(champion, "draw").withColumn("_s", F.when(F.col("_c") != 0, 1 - F.col("mae") / F.col("_c")).otherwise(0.0))
    out = each.select("algorithm", "_s").join(total, "algorithm").groupBy("algorithm", "champion", "mae", "skill").agg(F.percentile("_s", 0.025 / family).alias("lower"), ((1 + F.count_if(F.col("_s") - F.col("skill") >= F.col("skill"))) / (F.count("*") + 1)).alias("p"))
    return out.withColumn("margin_pass", F.col("lower") > 0.02)


def coverage_intervals(draws: DataFrame, whole: DataFrame, nominal: float, tolerance: float) -> DataFrame:
    """Asset, coverage, its 95 % bootstrap interval and whether it lies within the tolerance of the nominal one."""
    each = draws.groupBy("asset").agg(F.percentile(F.try_divide("covered", "n"), 0.025).alias("lower"), F.percentile(F.try_divide("covered", "n"), 0.975).alias("upper"))
    have = whole.groupBy("asset").agg(F.try_divide(F.sum("covered"), F.sum("n")).alias("coverage"))
    return have.join(each, "asset").withColumn("tolerance_met", F.abs(F.col("coverage") - nominal) <= tolerance)


def guarded(requests: DataFrame, reserved_from_ns: int) -> DataFrame:
    """requests(id, operation, first_ns, last_ns, label_ns) with access_allowed or access_denied: rows and labels must
    end before the reserved range, builds and labelled data are never let in."""
    fine = (F.col("operation") != "build") & (F.col("first_ns") >= 0) & (F.col("first_ns") <= F.col("last_ns")) & (F.col("last_ns") < reserved_from_ns) & (F.col("label_ns") == 0)
    return requests.withColumn("access", F.when(F.coalesce(fine, F.lit(False)), "access_allowed").otherwise("access_denied"))


def same_cases(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Errors of two forecast sets on the cases both have, by group, with the cases that only one has."""
    both = left.select(*dict.fromkeys([*keys, *by]), "target", F.col("prediction").alias("_l")).join(right.select(*keys, F.col("prediction").alias("_r")), keys, "left")
    found = F.col("_r").isNotNull()
    error = lambda c: F.round(F.avg(F.when(found, F.abs(F.col(c) - F.col("target")))), 8)
    return both.groupBy(*by).agg(F.count_if(found).alias("n"), F.count_if(~found).alias("only_left"), error("_l").alias("left_mae"), error("_r").alias("right_mae"))


