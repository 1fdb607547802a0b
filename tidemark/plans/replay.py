"""Queries of eligibility, replay, frozen predictions and comparison (J3 to J6, J12 to J16, J18, J19, J21, J22). The catalog imports this module."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.catalog import ORIGIN_SQL, PROB_SQL, RET_SQL, SPLITS, T0, H, probabilities, query, returns, with_
from tidemark.functions import expressions as X
from tidemark.operators import derive, replay, scores
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.contracts import FIVE_SQL, five_quantiles
from tidemark.sources.scratch import durable, fresh
from tidemark.sources.views import BARS_SQL, bars

DAY = X.DAY_NS
EMBARGO, LOOKBACK = 24 * H, 12 * H
SPLIT_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPLITS)


def structural_sql(horizon: int) -> str:
    return f"CASE WHEN origin_ns < lo + {EMBARGO} THEN 'embargo' WHEN origin_ns - {LOOKBACK} < first_start THEN 'missing-history-boundary' WHEN origin_ns + {horizon * H} >= hi THEN 'split-endpoint' END"


CAND_SQL = f", c AS (SELECT e.series, first_start, s.split, s.lo, s.hi, unnest(range(s.lo, s.hi, {H})) AS origin_ns FROM (SELECT series, min(start_ns) AS first_start FROM bars GROUP BY 1) e CROSS JOIN (VALUES {SPLIT_VALUES}) s(split, lo, hi))"


@query(with_(BARS_SQL, CAND_SQL + f" SELECT series, split, coalesce({structural_sql(48)}, 'eligible') AS reason, count(*) AS n FROM c GROUP BY 1, 2, 3"))
def j3_structural_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Every hour of every split: the embargo at its start first, then the history, then an endpoint at or behind its end."""
    c = replay.candidates(bars(spark, sf), SPLITS)
    reason = replay.structural_reason(F.col("origin_ns"), F.col("split_start"), F.col("split_end"), EMBARGO, F.col("first_start"), LOOKBACK, F.lit(48 * H))
    return c.groupBy("series", "split", F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(with_(BARS_SQL, ORIGIN_SQL + f""", e AS (SELECT b.series, b.start_ns FROM bars b WHERE (SELECT count(*) FROM bars x WHERE x.series = b.series AND x.finalized AND x.start_ns BETWEEN b.start_ns - {3 * H} AND b.start_ns) = 4){CAND_SQL}
SELECT c.series, c.split, coalesce({structural_sql(4).replace('origin_ns', 'c.origin_ns')}, CASE WHEN o.origin_ns IS NULL THEN 'missing' ELSE o.reason END, CASE WHEN e.start_ns IS NULL THEN 'outcome-missing' ELSE 'matured' END) AS state, count(*) AS n
FROM c LEFT JOIN o ON o.series = c.series AND o.origin_ns = c.origin_ns LEFT JOIN e ON e.series = c.series AND e.start_ns = c.origin_ns + {3 * H} GROUP BY 1, 2, 3"""))
def j4_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    origins = scores.origins(b, 12)
    rows = replay.feasibility(replay.candidates(b, SPLITS), origins, scores.outcomes(b, origins, 4), EMBARGO, LOOKBACK, 4 * H)
    return rows.groupBy("series", "split", "state").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {BARS_SQL}" + ORIGIN_SQL + f""", e AS (SELECT b.series, b.start_ns FROM bars b WHERE (SELECT count(*) FROM bars x WHERE x.series = b.series AND x.finalized AND x.start_ns BETWEEN b.start_ns - {3 * H} AND b.start_ns) = 4){CAND_SQL},
m AS (SELECT c.series, c.split, c.origin_ns FROM c JOIN o ON o.series = c.series AND o.origin_ns = c.origin_ns AND o.reason IS NULL JOIN e ON e.series = c.series AND e.start_ns = c.origin_ns + {3 * H} WHERE {structural_sql(4).replace('origin_ns', 'c.origin_ns')} IS NULL),
g AS (SELECT series, split, min(origin_ns) AS s FROM m GROUP BY 1, 2 UNION ALL SELECT g.series, g.split, (SELECT min(origin_ns) FROM m WHERE m.series = g.series AND m.split = g.split AND m.origin_ns >= g.s + {24 * H}) FROM g WHERE g.s IS NOT NULL),
k AS (SELECT series, split, count(s) AS blocks FROM g GROUP BY 1, 2), t AS (SELECT series, split, count(*) AS structural FROM c WHERE {structural_sql(4)} IS NULL GROUP BY 1, 2), n AS (SELECT series, split, count(*) AS matured FROM m GROUP BY 1, 2)
SELECT split, min(blocks) AS least_blocks, bool_and(100 * matured >= 30 * structural) AS complete, bool_and(blocks >= 3) AS enough FROM k JOIN t USING (series, split) JOIN n USING (series, split) GROUP BY 1""")
def e13_feasibility_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness (here 30 %) and a floor of three blocks a day apart, over all series of a split."""
    b = bars(spark, sf)
    origins = scores.origins(b, 12)
    rows = replay.feasibility(replay.candidates(b, SPLITS), origins, scores.outcomes(b, origins, 4), EMBARGO, LOOKBACK, 4 * H)
    structural = ~F.col("state").isin("embargo", "missing-history-boundary", "split-endpoint")
    n = rows.groupBy("series", "split").agg(F.count_if(structural | ((F.col("state") == "missing-history-boundary") & (F.col("origin_ns") - LOOKBACK >= F.col("first_start")))).alias("structural"), F.count_if(F.col("state") == "matured").alias("matured"))
    blocks = scores.blocks(rows.where("state = 'matured'").select("series", "split", F.col("origin_ns").alias("start_ns")), ["series", "split"], 24 * H)
    both = n.join(blocks, ["series", "split"])
    return both.groupBy("split").agg(F.min(F.col("blocks").cast("bigint")).alias("least_blocks"), F.bool_and(100 * F.col("matured") >= 30 * F.col("structural")).alias("complete"), F.bool_and(F.col("blocks") >= 3).alias("enough"))


TRAIN, TEST, LAGS, AHEAD, LATE = SPLITS[0], SPLITS[2], 3, 2, 60_000_000_000


def eligibility_sql(training: bool) -> str:
    lo, hi = (TRAIN if training else TEST)[1:]
    cut = TRAIN[2] if training else hi
    purge = "" if training else f"WHEN origin_ns - {LAGS * H} <= {TRAIN[2] + 24 * H} THEN 'purge-or-embargo' "
    return f"""SELECT '{'training' if training else 'evaluation'}' AS mode, CASE WHEN origin_ns + {AHEAD * H} + {LATE} >= {cut} THEN 'immature-or-boundary-label' WHEN (origin_ns - {T0}) // {H} - 1 < {LAGS} THEN 'missing-feature-history' {purge}
WHEN EXISTS (SELECT 1 FROM gaps WHERE gaps.start_ns BETWEEN origin_ns - {(LAGS + 1) * H} AND origin_ns + {(AHEAD - 1) * H}) THEN 'incomplete-common-pair' ELSE 'selected' END AS state FROM (SELECT unnest(range({lo}, {hi}, {H})) AS origin_ns)"""


@query(with_(BARS_SQL, f""", gaps AS (SELECT h.start_ns FROM (SELECT unnest(range({T0}, {SPLITS[2][2]}, {H})) AS start_ns) h LEFT JOIN bars b ON b.start_ns = h.start_ns GROUP BY 1 HAVING count(b.series) < (SELECT count(DISTINCT series) FROM bars))
SELECT mode, state, count(*) AS n FROM ({eligibility_sql(True)} UNION ALL {eligibility_sql(False)}) GROUP BY 1, 2"""))
def j5_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Training and evaluation origins that every series can serve: three lag hours and a label of two."""
    b, out = bars(spark, sf), None
    for training in (True, False):
        lo, hi = (TRAIN if training else TEST)[1:]
        rows = replay.eligibility(b, T0, lo, hi, AHEAD, TRAIN[2] if training else hi, training, LAGS, 24 * H, LATE, TRAIN[2]).withColumn("mode", F.lit("training" if training else "evaluation"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("mode", "state").agg(F.count("*").alias("n"))


#: Receipts: two hours late at hour 7, of unknown time at 11; hour 15 lies in no complete coverage.
REPLAY_SQL = f""", a AS (SELECT series, start_ns, finalized, "close", (start_ns // {H}) % 24 AS h FROM bars), r AS (SELECT *, CASE WHEN h <> 11 THEN start_ns + {H} + CASE WHEN h = 7 THEN {2 * H} ELSE 5000 END END AS av, h <> 15 AS cov FROM a),
j AS (SELECT r.*, l.finalized AS lf, l.av AS lav, l.cov AS lcov, n.finalized AS nf, n.av AS nav, n.cov AS ncov, r.start_ns + {H} + 1000000 AS o FROM r LEFT JOIN r l ON l.series = r.series AND l.start_ns = r.start_ns - {H} LEFT JOIN r n ON n.series = r.series AND n.start_ns = r.start_ns + {H}),
p AS (SELECT j.*, s.split AS part, s.hi AS boundary FROM j LEFT JOIN (VALUES {SPLIT_VALUES}) s(split, lo, hi) ON o - 1000 >= lo AND o + 1000 < hi),
q AS (SELECT *, av IS NULL OR lav IS NULL AS tq, NOT cov OR NOT lcov AS cq, av IS NULL OR lav IS NULL OR greatest(av, lav) > o - 1000 AS late FROM p),
cases AS (SELECT *, CASE WHEN part IS NULL THEN 'outside-or-crossing-split' WHEN NOT finalized THEN 'not-finalized' WHEN lf IS NULL THEN 'lag-gap-or-missing' WHEN NOT lf THEN 'lag-not-finalized'
  WHEN tq OR cq OR late THEN concat_ws(',', CASE WHEN cq THEN 'coverage' END, CASE WHEN late THEN 'feature-unavailable' END, CASE WHEN tq THEN 'time-quality' END)
  WHEN nf AND start_ns + {2 * H} <= o + 1000 THEN 'label-not-future' WHEN nf AND start_ns + {2 * H} >= boundary THEN 'label-purged' WHEN nf IS NULL THEN 'label-gap-or-missing' WHEN NOT nf THEN 'label-not-finalized'
  WHEN nav IS NULL OR nav > boundary - 1001 THEN 'label-availability-purged' WHEN NOT ncov THEN 'label-coverage' ELSE 'case' END AS reason FROM q)"""


def cases_of(spark: SparkSession, sf: str) -> DataFrame:
    h = F.expr(f"start_ns div {H} % 24")
    known = F.when(h != 11, F.col("start_ns") + H + F.when(h == 7, 2 * H).otherwise(5000))
    b = bars(spark, sf).select("series", "start_ns", "close", "finalized", known.alias("available_ns"), (h != 15).alias("covered"))
    return replay.replay_cases(b, SPLITS, 1_000_000, 1000)


@query(with_(BARS_SQL, REPLAY_SQL + " SELECT series, start_ns, part, reason FROM cases"))
def j6_replay_cases(spark: SparkSession, sf: str) -> DataFrame:
    return cases_of(spark, sf).select("series", "start_ns", "part", "reason")


@query(with_(BARS_SQL, REPLAY_SQL + f""", l AS (SELECT c.series, c.part, c.start_ns, c."close" AS prediction, b."close" AS target FROM cases c JOIN bars b ON b.series = c.series AND b.start_ns = c.start_ns + {H} WHERE reason = 'case')
SELECT series, part, count(*) FILTER (WHERE (start_ns // {H}) % 5 <> 2) AS n, count(*) FILTER (WHERE (start_ns // {H}) % 5 = 2) AS only_left, round(avg(abs(prediction - target)) FILTER (WHERE (start_ns // {H}) % 5 <> 2), 8) AS left_mae, round(avg(abs(0.5 * prediction - target)) FILTER (WHERE (start_ns // {H}) % 5 <> 2), 8) AS right_mae FROM l GROUP BY 1, 2"""))
def j22_same_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence against half of it on the cases both have; the second lacks every fifth hour."""
    target = bars(spark, sf).select("series", (F.col("start_ns") - H).alias("start_ns"), F.col("close").alias("target"))
    left = cases_of(spark, sf).where("reason = 'case'").join(target, ["series", "start_ns"]).withColumnRenamed("close", "prediction")
    right = left.where(F.expr(f"start_ns div {H} % 5") != 2).select("series", "start_ns", (0.5 * F.col("prediction")).alias("prediction"))
    return replay.same_cases(left, right, ["series", "start_ns"], ["series", "part"])


@query(with_(BARS_SQL, f""", d AS (SELECT series, start_ns // {DAY} AS day, min(start_ns) AS a, max(start_ns) AS b FROM bars GROUP BY 1, 2)
SELECT series, op AS operation, CASE WHEN op <> 'build' AND b < {SPLITS[2][1]} AND NOT (op = 'evaluate') THEN 'access_allowed' ELSE 'access_denied' END AS access, count(*) AS n FROM d CROSS JOIN (SELECT unnest(['read', 'build', 'evaluate']) AS op) GROUP BY 1, 2, 3"""))
def j21_reserved_range(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for each series' days: those in the reserved split, builds and labelled data are denied; all are logged."""
    d = bars(spark, sf).groupBy("series", F.expr(f"start_ns div {DAY}").alias("day")).agg(F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns"))
    asked = d.withColumn("operation", F.explode(F.array(F.lit("read"), F.lit("build"), F.lit("evaluate")))).withColumn("label_ns", F.when(F.col("operation") == "evaluate", H).otherwise(0))
    return replay.guarded(asked, SPLITS[2][1]).groupBy("series", "operation", "access").agg(F.count("*").alias("n"))


# ---- models ------------------------------------------------------------------------------------------------
def featured(spark: SparkSession, sf: str, lags: int) -> DataFrame:
    """series, start_ns, features (lagged returns, newest last) and the next hour's return as target."""
    b = bars(spark, sf)
    t = returns(spark, sf).select("series", "start_ns", "target")
    return derive.lagged_returns(b, lags).where("features is not null").join(t, ["series", "start_ns"])


@query()
def j12_ridge_lags(spark: SparkSession, sf: str) -> DataFrame:
    """AR(6) by series on whole histories of six returns; a test holds it against numpy."""
    return ridge_lags(spark, sf, 6)


@query()
def j12_ridge_24(spark: SparkSession, sf: str) -> DataFrame:
    """AR(24) by series on whole histories of a day; a test holds it against numpy."""
    return ridge_lags(spark, sf, 24)


def ridge_lags(spark: SparkSession, sf: str, lags: int) -> DataFrame:
    m = replay.ridge(featured(spark, sf, lags), ["series"], lags)
    return m.select("series", "n", F.round("intercept", 8).alias("intercept"), F.transform("coefficients", lambda c: F.round(c, 6)).alias("coefficients"))


LAG_SQL = RET_SQL + f""", r AS (SELECT series, start_ns, ln("close") - ln(lag("close") OVER w) AS ret, start_ns - lag(start_ns, 6) OVER w AS back FROM bars WINDOW w AS (PARTITION BY series ORDER BY start_ns)),
f AS (SELECT series, start_ns, back, greatest(1e-12, sqrt(avg(ret * ret) OVER (PARTITION BY series ORDER BY start_ns ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))) AS scale FROM r), v AS (SELECT p.series, p.start_ns, p.target / f.scale AS u FROM f JOIN p USING (series, start_ns) WHERE back = {6 * H})"""


@query(with_(BARS_SQL, LAG_SQL + " SELECT series, count(*) AS n, round(quantile_cont(u, 0.025), 6) AS q025, round(quantile_cont(u, 0.1), 6) AS q10, round(quantile_cont(u, 0.5), 6) AS q50, round(quantile_cont(u, 0.9), 6) AS q90, round(quantile_cont(u, 0.975), 6) AS q975, round((count(*) FILTER (WHERE u > 0) + 0.5) / (count(*) FILTER (WHERE u <> 0) + 1), 8) AS p_up FROM v GROUP BY 1"))
def j13_empirical(spark: SparkSession, sf: str) -> DataFrame:
    """Targets in units of their own history's volatility: empirical quantiles and the smoothed probability of a rise."""
    rms = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x) / 6)
    u = featured(spark, sf, 6).select("series", (F.col("target") / F.greatest(F.lit(1e-12), rms)).alias("u"))
    q = {"q025": 0.025, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q975": 0.975}
    u = durable(u, "scaled-targets")
    at = exact_quantiles(u, ["series"], "u", q).select("series", *[F.round(n, 6).alias(n) for n in q])
    return u.groupBy("series").agg(F.count("*").alias("n"), F.round((F.count_if(F.col("u") > 0) + 0.5) / (F.count_if(F.col("u") != 0) + 1), 8).alias("p_up")).join(at, "series").select("series", "n", *q, "p_up")


@query(with_(BARS_SQL, LAG_SQL + f""" SELECT series, CASE WHEN (start_ns // {H}) % 24 = 4 THEN 'differs' WHEN (start_ns // {H}) % 24 = 5 THEN 'only-recomputed' WHEN series = 'view' AND (start_ns // {H}) % 24 = 6 THEN 'only-stored' ELSE 'same' END AS state, count(*) AS n FROM v GROUP BY 1, 2"""))
def j14_frozen_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters written once, predictions recomputed from them; some stored predictions were changed, some lack on either side."""
    rows = featured(spark, sf, 6)
    path = fresh(spark, "frozen")
    replay.ridge(rows.where(F.col("start_ns") < TRAIN[2]), ["series"], 6).write.parquet(path)
    model = spark.read.schema("series string, n bigint, intercept double, means array<double>, scales array<double>, coefficients array<double>").parquet(path)
    h = F.expr(f"start_ns div {H} % 24")
    now = replay.predicted(rows, model, ["series"])
    stored = now.where(h != 5).withColumn("prediction", F.when(h == 4, F.col("prediction") + 1e-3).otherwise(F.col("prediction")))
    return replay.verified(now.where((h != 6) | (F.col("series") != "view")), stored, ["series", "start_ns"]).groupBy("series", "state").agg(F.count("*").alias("n"))


# ---- comparison --------------------------------------------------------------------------------------------
BLOCK = 7


def daily_errors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """(algorithm, asset, day index from the first day, loss, n; the days): all days of the data, empty ones count nothing."""
    p = returns(spark, sf).select("series", F.expr(f"start_ns div {DAY}").alias("d"), "prediction", "target")
    t = F.col("target")
    each = {"momentum": F.abs(F.col("prediction") - t), "reversal": F.abs(-F.col("prediction") - t), "zero": F.abs(t)}
    first, days = p.agg(F.coalesce(F.min("d"), F.lit(0)), F.coalesce(F.max("d") - F.min("d") + 1, F.lit(1))).first()
    sums = p.groupBy("series", "d").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in each.items()]).withColumn("day", F.col("d") - F.lit(first)).drop("d")
    grid = sums.select("series").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(days - 1).cast("bigint"))))
    rows = grid.join(sums, ["series", "day"], "left").na.fill(0, ["n"]).na.fill(0.0, list(each))
    long = rows.unpivot(["series", "day", "n"], list(each), "algorithm", "loss")
    return long.withColumnRenamed("series", "asset"), days


def draw_values(days: int) -> str:
    """The draws of the seed over so many days, as SQL rows."""
    rng, tail, rows = random.Random(42), days % BLOCK, []
    for draw in range(2000):
        rows += [(draw, rng.randrange(days - BLOCK + 1), BLOCK) for _ in range(days // BLOCK)]
        rows += [(draw, rng.randrange(days - tail + 1), tail)] if tail else []
    return ", ".join(f"({a},{b},{c})" for a, b, c in rows)


#: The events cover 30 days at every scale.
DRAW_SQL = f""", draws(draw, a, take) AS (VALUES {draw_values(30)})"""
BOOT_SQL = RET_SQL + f""", lim AS (SELECT min(start_ns // {DAY}) AS d0 FROM p), al AS (SELECT unnest(['momentum', 'reversal', 'zero']) AS algorithm),
dl AS (SELECT algorithm, series AS asset, start_ns // {DAY} - d0 AS day, count(*) AS n, sum(abs(CASE algorithm WHEN 'momentum' THEN prediction WHEN 'reversal' THEN -prediction ELSE 0 END - target)) AS loss FROM p CROSS JOIN lim CROSS JOIN al GROUP BY 1, 2, 3)""" + DRAW_SQL + """,
smp AS (SELECT algorithm, asset, draw, sum(loss) / sum(n) AS m FROM draws JOIN dl ON day >= a AND day < a + take GROUP BY 1, 2, 3), sd AS (SELECT algorithm, draw, avg(m) AS m FROM smp GROUP BY 1, 2),
tot AS (SELECT algorithm, avg(m) AS mae FROM (SELECT algorithm, asset, sum(loss) / sum(n) AS m FROM dl GROUP BY 1, 2) GROUP BY 1), ch AS (SELECT arg_min(algorithm, (mae, algorithm)) AS champion, min(mae) AS best FROM tot)"""


@query(with_(BARS_SQL, BOOT_SQL + """, sk AS (SELECT s.algorithm, 1 - s.m / c.m AS s, t.mae, 1 - t.mae / ch.best AS skill, ch.champion FROM sd s JOIN ch ON true JOIN sd c ON c.draw = s.draw AND c.algorithm = ch.champion JOIN tot t ON t.algorithm = s.algorithm)
SELECT algorithm, champion, round(any_value(mae), 8) AS mae, round(any_value(skill), 8) AS skill, round(quantile_cont(s, 0.025 / 3), 8) AS lower, round((1 + count(*) FILTER (WHERE round(s - skill - skill, 12) >= 0)) / 2001, 8) AS p, quantile_cont(s, 0.025 / 3) > 0.02 AS margin_pass FROM sk GROUP BY 1, 2"""))
def j15_j16_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Paired moving-block bootstrap of all series and models over all days: 2,000 draws, a tail block, skill against the champion."""
    daily, days = daily_errors(spark, sf)
    table = scores.draws(spark, days, BLOCK)
    drawn = replay.resampled(daily, table, ["algorithm", "asset"], ["loss", "n"])
    whole = daily.groupBy("algorithm", "asset").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    out = replay.skills(drawn, whole, 3)
    return out.select("algorithm", "champion", *[F.round(c, 8).alias(c) for c in ("mae", "skill", "lower", "p")], "margin_pass")


@query(with_(BARS_SQL, PROB_SQL + f""", lim AS (SELECT min(start_ns // {DAY}) AS d0 FROM q), dl AS (SELECT series AS asset, start_ns // {DAY} - d0 AS day, count(*) AS n, count(*) FILTER (WHERE target BETWEEN q10 AND q90) AS covered FROM q CROSS JOIN lim GROUP BY 1, 2)""" + DRAW_SQL + """,
smp AS (SELECT asset, draw, sum(covered) / sum(n) AS c FROM draws JOIN dl ON day >= a AND day < a + take GROUP BY 1, 2)
SELECT asset, round(any_value(w.coverage), 8) AS coverage, round(quantile_cont(c, 0.025), 8) AS lower, round(quantile_cont(c, 0.975), 8) AS upper, abs(any_value(w.coverage) - 0.8) <= 0.05 AS tolerance_met FROM smp JOIN (SELECT asset, sum(covered) / sum(n) AS coverage FROM dl GROUP BY 1) w USING (asset) GROUP BY 1"""))
def j18_coverage_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_of(spark, probabilities(spark, sf), F.col("target").between(F.col("q10"), F.col("q90")), 0.8)


def coverage_of(spark: SparkSession, rows: DataFrame, inside: Column, nominal: float) -> DataFrame:
    """J18 of one band: coverage of each asset over all days, its interval from the shared draws, tolerance of 0.05."""
    q = rows.select(F.col("series").alias("asset"), F.expr(f"start_ns div {DAY}").alias("d"), inside.cast("bigint").alias("covered"))
    first, days = q.agg(F.coalesce(F.min("d"), F.lit(0)), F.coalesce(F.max("d") - F.min("d") + 1, F.lit(1))).first()
    sums = q.groupBy("asset", (F.col("d") - F.lit(first)).alias("day")).agg(F.count("*").alias("n"), F.sum("covered").alias("covered"))
    grid = sums.select("asset").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(days - 1).cast("bigint"))))
    daily = grid.join(sums, ["asset", "day"], "left").na.fill(0, ["n", "covered"])
    drawn = replay.resampled(daily, scores.draws(spark, days, BLOCK), ["asset"], ["covered", "n"])
    out = replay.coverage_intervals(drawn, daily, nominal, 0.05)
    return out.select("asset", *[F.round(c, 8).alias(c) for c in ("coverage", "lower", "upper")], "tolerance_met")


@query(with_(BARS_SQL, FIVE_SQL + f""", lim AS (SELECT min(start_ns // {DAY}) AS d0 FROM five), b(band, nominal) AS (VALUES ('80', 0.8), ('95', 0.95)),
dl AS (SELECT series AS asset, band, any_value(nominal) AS nominal, start_ns // {DAY} - d0 AS day, count(*) AS n, count(*) FILTER (WHERE CASE band WHEN '80' THEN target BETWEEN x10 AND x90 ELSE target BETWEEN x025 AND x975 END) AS covered FROM five CROSS JOIN lim CROSS JOIN b GROUP BY 1, 2, 4)""" + DRAW_SQL + """,
smp AS (SELECT asset, band, draw, sum(covered) / sum(n) AS c FROM draws JOIN dl ON day >= a AND day < a + take GROUP BY 1, 2, 3)
SELECT asset, band, round(any_value(w.coverage), 8) AS coverage, round(quantile_cont(c, 0.025), 8) AS lower, round(quantile_cont(c, 0.975), 8) AS upper, abs(any_value(w.coverage) - any_value(w.nominal)) <= 0.05 AS tolerance_met
FROM smp JOIN (SELECT asset, band, any_value(nominal) AS nominal, sum(covered) / sum(n) AS coverage FROM dl GROUP BY 1, 2) w USING (asset, band) GROUP BY 1, 2"""))
def j18_coverage_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The 80 and the 95 % band of five quantiles, from the same draws."""
    rows = five_quantiles(spark, sf)
    one, two = (coverage_of(spark, rows, F.col("target").between(F.col(lo), F.col(hi)), nominal).withColumn("band", F.lit(band)) for band, nominal, lo, hi in (("80", 0.8, "x10", "x90"), ("95", 0.95, "x025", "x975")))
    return one.union(two)


@query(with_(BARS_SQL, RET_SQL + f""" SELECT series, CAST(2 AS BIGINT) AS algorithms, count(*) AS cases, series <> 'view' AS same FROM p GROUP BY 1"""))
def j19_pair_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' cases by series: the second has another case of one hour of views."""
    p = returns(spark, sf).select("series", "start_ns")
    last = F.max("start_ns").over(W.partitionBy("series"))
    two = p.withColumn("last", last).withColumn("start_ns", F.when((F.col("series") == "view") & (F.col("start_ns") == F.col("last")), F.col("start_ns") + 1).otherwise(F.col("start_ns"))).drop("last")
    rows = p.withColumn("algorithm", F.lit("a")).union(two.withColumn("algorithm", F.lit("b")))
    return replay.pair_identity(rows, ["series"], "algorithm", F.concat_ws("|", "series", F.col("start_ns").cast("string")))
