"""More queries over the driver tables: pages, contracts, joins, gates, forecasts and keys. The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.catalog import KIND_SQL, RET_SQL, SPLITS, T0, H, query, returns, with_
from tidemark.functions import expressions as X
from tidemark.operators import classify
from tidemark.sources.views import BARS_SQL, OBS_SQL, TICKS_SQL, bars, observations, table, ticks

DAY = X.DAY_NS
TRAIN_END = SPLITS[0][2]


# ---- pages and contracts -----------------------------------------------------------------------------------
@query(with_(BARS_SQL, f""", pages AS (SELECT start_ns // {DAY} AS page, series, start_ns, "close" FROM bars
  UNION ALL SELECT start_ns // {DAY} - 1, series, start_ns, "close" FROM bars WHERE start_ns % {DAY} < {6 * H})
SELECT series, start_ns, min("close") AS "close", count(*) AS n_pages, count(DISTINCT "close") > 1 AS conflict FROM pages GROUP BY 1, 2"""))
def a5_merge_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Daily pages that reach six hours into the next day, merged to one candle a key; unequal repeats conflict."""
    day = F.expr(f"start_ns div {DAY}")
    held = F.when(F.pmod("start_ns", F.lit(DAY)) < 6 * H, F.array(day, day - 1)).otherwise(F.array(day))
    pages = bars(spark, sf).select(F.explode(held).alias("page"), "series", "start_ns", "close")
    return pages.groupBy("series", "start_ns").agg(F.min("close").alias("close"), F.count("*").alias("n_pages"), (F.min("close") != F.max("close")).alias("conflict"))


@query("""SELECT page_id, regexp_matches(coalesce(url, ''), '^[A-Za-z0-9][A-Za-z0-9._:/-]*$') AND length(url) <= 128 AS identifier, url IS NOT NULL AS digest FROM pages""")
def b8_text_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.is_identifier(F.col("url")).alias("identifier"), X.is_digest(F.sha2("url", 256)).alias("digest"))


JSON_SQL = """, j AS (SELECT series, off, '{"ns":' || ns || ',"offset":' || off || ',"producer":' || producer || ',"series":"' || series || '"}' AS body FROM ticks)"""


def canonical_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Field names ascending, nulls kept."""
    body = F.to_json(F.struct("ns", "offset", "producer", "series"), {"ignoreNullFields": "false"})
    return ticks(spark, sf).select("series", "offset", body.alias("body"))


@query(with_(TICKS_SQL, JSON_SQL + " SELECT series, count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS logical_bytes FROM j GROUP BY 1"))
def b17_logical_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_ticks(spark, sf).groupBy("series").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("logical_bytes"))


@query(with_(TICKS_SQL, JSON_SQL + ' SELECT off AS "offset", body FROM j'))
def b21_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_ticks(spark, sf).select("offset", "body")


@query(with_(TICKS_SQL, JSON_SQL + ' SELECT off AS "offset", sha256(body) AS fingerprint FROM j'))
def l1_input_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_ticks(spark, sf).select("offset", F.sha2("body", 256).alias("fingerprint"))


@query(with_(BARS_SQL, f""" SELECT series, count(*) AS n, count(*) FILTER (WHERE start_ns % {H} <> 0) AS off_grid, count(*) FILTER (WHERE NOT (low >= 0 AND low <= least(open, "close") AND greatest(open, "close") <= high)) AS bad_prices,
count(*) FILTER (WHERE NOT regexp_matches(series, '^[a-z_]+$')) AS bad_series, count(*) FILTER (WHERE n <= 1) AS single_tick FROM bars GROUP BY 1"""))
def b18_row_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of each rule in one pass."""
    rules = {
        "off_grid": F.pmod("start_ns", F.lit(H)) != 0, "bad_prices": ~X.ohlc_consistent(F.col("open"), F.col("high"), F.col("low"), F.col("close")),
        "bad_series": ~F.col("series").rlike("^[a-z_]+$"), "single_tick": F.col("n") <= 1,
    }
    return bars(spark, sf).groupBy("series").agg(F.count("*").alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


@query(with_(BARS_SQL, f""", f AS (SELECT series, start_ns // {DAY} AS day, start_ns, start_ns - lag(start_ns) OVER (PARTITION BY series, start_ns // {DAY} ORDER BY start_ns) AS step FROM bars)
SELECT series, day, CASE WHEN min(start_ns) <> day * {DAY} THEN 'first' WHEN count(*) <> 24 THEN 'count' WHEN count(*) FILTER (WHERE step <> {H}) > 0 THEN 'step' ELSE 'ok' END AS state FROM f GROUP BY 1, 2"""))
def b22_forecast_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A day's rows as a forecast of 24 steps: first time, count, equal steps."""
    day = F.expr(f"start_ns div {DAY}")
    rows = bars(spark, sf).select("series", day.alias("day"), "start_ns")
    rows = rows.withColumn("step", F.col("start_ns") - F.lag("start_ns").over(W.partitionBy("series", "day").orderBy("start_ns")))
    out = rows.groupBy("series", "day").agg(F.min("start_ns").alias("a"), F.count("*").alias("n"), F.count_if(F.col("step") != H).alias("bad"))
    state = F.when(F.col("a") != F.col("day") * DAY, "first").when(F.col("n") != 24, "count").when(F.col("bad") > 0, "step").otherwise("ok")
    return out.select("series", "day", state.alias("state"))


# ---- joins -------------------------------------------------------------------------------------------------
@query(with_(OBS_SQL, KIND_SQL + """ SELECT k.kind, count(*) AS n, count(DISTINCT s.revision) AS n_revisions FROM kinds k JOIN (SELECT revision, min(off) AS first_off FROM obs GROUP BY 1) s ON k.revision = s.revision GROUP BY 1"""))
def c3_outcome_join(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    semantic = o.groupBy("revision").agg(F.min("offset").alias("first_offset"))
    return classify.classified(o).join(semantic, "revision").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("revision").alias("n_revisions"))


@query(with_(BARS_SQL, f""" SELECT a.series, a.start_ns, a."close", b."close" AS end_close FROM bars a LEFT JOIN bars b ON a.series = b.series AND b.start_ns = a.start_ns + {DAY}"""))
def c7_endpoint_join(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    ends = b.select("series", (F.col("start_ns") - DAY).alias("start_ns"), F.col("close").alias("end_close"))
    return b.select("series", "start_ns", "close").join(ends, ["series", "start_ns"], "left")


@query(with_(BARS_SQL, f""" SELECT series, start_ns AS origin_ns, count(*) OVER w AS n_hours, CAST(sum(n) OVER w AS BIGINT) AS n_ticks FROM bars
WINDOW w AS (PARTITION BY series ORDER BY start_ns RANGE BETWEEN {6 * H} PRECEDING AND 1 PRECEDING)"""))
def c8_range_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """What lies in [origin - 6 h, origin), by a range frame."""
    past = W.partitionBy("series").orderBy("start_ns").rangeBetween(-6 * H, -1)
    return bars(spark, sf).select("series", F.col("start_ns").alias("origin_ns"), F.count("*").over(past).alias("n_hours"), F.sum("n").over(past).alias("n_ticks"))


@query(with_(BARS_SQL, """, c AS (SELECT start_ns FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series) FROM bars)) SELECT series, start_ns, "close" FROM bars SEMI JOIN c USING (start_ns)"""))
def c13_common_origins(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    every = b.agg(F.count_distinct("series").alias("every"))
    common = b.groupBy("start_ns").agg(F.count("*").alias("have")).join(F.broadcast(every), F.col("have") == F.col("every")).select("start_ns")
    return b.join(common, "start_ns", "left_semi").select("series", "start_ns", "close")


# ---- aggregates, gates, order ------------------------------------------------------------------------------
@query(with_(BARS_SQL, RET_SQL + """, m AS (SELECT series, unnest(['momentum', 'reversal', 'zero']) AS model, unnest([avg(abs(prediction - target)), avg(abs(-prediction - target)), avg(abs(target))]) AS mae FROM p GROUP BY 1),
e AS (SELECT model, avg(mae) AS mae FROM m GROUP BY 1) SELECT model, round(mae, 6) AS mae, model = (SELECT arg_min(model, (mae, model)) FROM e) AS champion FROM e"""))
def e10_champion(spark: SparkSession, sf: str) -> DataFrame:
    """Each series counts alike; the champion has the least mean error, then the least name."""
    p, q, t = returns(spark, sf), F.col("prediction"), F.col("target")
    by_series = p.groupBy("series").agg(*[F.avg(F.abs(x - t)).alias(name) for name, x in (("momentum", q), ("reversal", -q), ("zero", F.lit(0.0)))])
    means = by_series.unpivot("series", ["momentum", "reversal", "zero"], "model", "mae").groupBy("model").agg(F.avg("mae").alias("mae"))
    best = means.agg(F.min_by("model", F.struct("mae", "model")).alias("best"))
    return means.join(F.broadcast(best)).select("model", F.round("mae", 6).alias("mae"), (F.col("model") == F.col("best")).alias("champion"))


@query(with_(OBS_SQL, KIND_SQL + " SELECT kind, series, count(*) AS n FROM kinds GROUP BY GROUPING SETS ((kind), (series, kind), ())"))
def e11_cohort_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = classify.classified(observations(spark, sf))
    return kinds.groupingSets([[F.col("kind")], [F.col("series"), F.col("kind")], []], F.col("series"), F.col("kind")).agg(F.count("*").alias("n")).select("kind", "series", "n")


@query(with_(BARS_SQL, f""", g AS (SELECT series, start_ns >= {TRAIN_END} AS late, count(*) FILTER (WHERE finalized) AS fit, count(*) AS n FROM bars GROUP BY 1, 2)
SELECT late, CAST(min(fit) AS BIGINT) AS least_rows, bool_and(100 * fit >= 99 * n) AS complete, bool_and(fit >= 20) AS enough FROM g GROUP BY 1"""))
def e13_gates(spark: SparkSession, sf: str) -> DataFrame:
    g = bars(spark, sf).groupBy("series", (F.col("start_ns") >= TRAIN_END).alias("late")).agg(F.count_if("finalized").alias("fit"), F.count("*").alias("n"))
    return g.groupBy("late").agg(F.min("fit").alias("least_rows"), F.bool_and(100 * F.col("fit") >= 99 * F.col("n")).alias("complete"), F.bool_and(F.col("fit") >= 20).alias("enough"))


@query(with_(BARS_SQL, ' SELECT start_ns, series, "close" FROM bars ORDER BY start_ns, series'))
def g1_canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("start_ns", "series", "close").orderBy("start_ns", "series")


@query(with_(TICKS_SQL, f""", p AS (SELECT series, off, ns, lag(off) OVER (PARTITION BY series ORDER BY off) AS before FROM ticks)
SELECT series, off AS "offset", before FROM p WHERE ns >= {TRAIN_END} ORDER BY off, series LIMIT 128"""))
def g2_catalog_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of 128 rows behind an anchor, each with the row it continues."""
    before = F.lag("offset").over(W.partitionBy("series").orderBy("offset"))
    return ticks(spark, sf).withColumn("before", before).where(F.col("ns") >= TRAIN_END).select("series", "offset", "before").orderBy("offset", "series").limit(128)


@query(with_(BARS_SQL, f""" SELECT series, start_ns, row_number() OVER (PARTITION BY series ORDER BY start_ns <= {TRAIN_END}, start_ns) AS turn FROM bars"""))
def g3_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Behind the cursor first, then from the start."""
    turn = F.row_number().over(W.partitionBy("series").orderBy(F.col("start_ns") <= TRAIN_END, "start_ns")).cast("bigint")
    return bars(spark, sf).select("series", "start_ns", turn.alias("turn"))


# ---- forecasts ---------------------------------------------------------------------------------------------
@query(with_(BARS_SQL, f""", r AS (SELECT series, ns - ns % {H} AS start_ns, max(ns) + 5000 AS upper_ns FROM ticks GROUP BY 1, 2), a AS (SELECT b.series, b.start_ns, greatest(b.start_ns + {H}, r.upper_ns) AS own_ns FROM bars b JOIN r USING (series, start_ns))
SELECT series, start_ns, own_ns, CASE WHEN count(*) OVER w = 3 THEN max(own_ns) OVER w END AS available_ns FROM a WINDOW w AS (PARTITION BY series ORDER BY start_ns ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def j7_availability(spark: SparkSession, sf: str) -> DataFrame:
    """A row is available when it and its two lag rows are: close of the candle or the receipt's upper bound."""
    start = F.col("ns") - F.pmod("ns", F.lit(H))
    own = ticks(spark, sf).groupBy("series", start.alias("start_ns")).agg(F.max("ns").alias("last")).select("series", "start_ns", F.greatest(F.col("start_ns") + H, F.col("last") + 5000).alias("own_ns"))
    past = W.partitionBy("series").orderBy("start_ns").rowsBetween(-2, 0)
    return own.withColumn("available_ns", F.when(F.count("*").over(past) == 3, F.max("own_ns").over(past)))


@query(with_(BARS_SQL, f""", t AS (SELECT series, avg(n) AS m, coalesce(nullif(stddev_pop(n), 0), 1) AS s FROM bars WHERE start_ns < {TRAIN_END} GROUP BY 1) SELECT series, start_ns, round((n - m) / s, 6) AS z FROM bars JOIN t USING (series)"""))
def j8_standardized(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and scale from the training rows only, applied to all; a constant has scale 1."""
    b = bars(spark, sf)
    fit = b.where(F.col("start_ns") < TRAIN_END).groupBy("series").agg(F.avg("n").alias("m"), F.coalesce(F.nullif(F.stddev_pop("n"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return b.join(fit, "series").select("series", "start_ns", F.round((F.col("n") - F.col("m")) / F.col("s"), 6).alias("z"))


@query(with_(BARS_SQL, """, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start_ns DESC) AS k FROM bars), l AS (SELECT series, max("close") FILTER (WHERE k = 1) AS last, max("close") FILTER (WHERE k = 2) AS before FROM r WHERE k <= 2 GROUP BY 1)
SELECT series, CAST(unnest(range(1, 25)) AS INTEGER) AS step, last AS persistence, round(last + (last - before) * unnest(range(1, 25)), 6) AS trend FROM l"""))
def j10_multi_step(spark: SparkSession, sf: str) -> DataFrame:
    """24 steps ahead of each series' last two closes; the rank filter prunes each task's rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy("series").orderBy(F.desc("start_ns")))
    two = bars(spark, sf).withColumn("k", rank).where("k <= 2").groupBy("series")
    ends = two.agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("before"))
    steps = ends.select("series", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("step"), "last", "before")
    return steps.select("series", "step", F.col("last").alias("persistence"), F.round(F.col("last") + (F.col("last") - F.col("before")) * F.col("step"), 6).alias("trend"))


@query(with_(BARS_SQL, RET_SQL + f""", m AS (SELECT series, avg(target) AS mean FROM p WHERE start_ns < {TRAIN_END} GROUP BY 1) SELECT series, count(*) AS n, round(avg(abs(target)), 8) AS zero_mae, round(avg(abs(target - mean)), 8) AS mean_mae FROM p JOIN m USING (series) WHERE start_ns >= {TRAIN_END} GROUP BY 1"""))
def j11_baselines(spark: SparkSession, sf: str) -> DataFrame:
    p, t = returns(spark, sf), F.col("target")
    mean = p.where(F.col("start_ns") < TRAIN_END).groupBy("series").agg(F.avg("target").alias("mean"))
    late = p.where(F.col("start_ns") >= TRAIN_END).join(mean, "series")
    return late.groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(t)), 8).alias("zero_mae"), F.round(F.avg(F.abs(t - F.col("mean"))), 8).alias("mean_mae"))


@query(with_(BARS_SQL, RET_SQL + """ SELECT series, start_ns, round(abs(prediction - target), 6) AS abs_error, round((prediction - target) * (prediction - target), 6) AS sq_error, round(abs(abs(prediction) - abs(target)), 6) AS magnitude_error,
CASE WHEN prediction <> 0 AND target <> 0 THEN sign(prediction) = sign(target) END AS direction_correct, prediction = 0 AS zero_prediction, target = 0 AS zero_target FROM p"""))
def k7_scores(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("prediction"), F.col("target")
    right = F.when((q != 0) & (t != 0), F.signum(q) == F.signum(t))
    return returns(spark, sf).select(
        "series", "start_ns", F.round(F.abs(q - t), 6).alias("abs_error"), F.round((q - t) * (q - t), 6).alias("sq_error"), F.round(F.abs(F.abs(q) - F.abs(t)), 6).alias("magnitude_error"),
        right.alias("direction_correct"), (q == 0).alias("zero_prediction"), (t == 0).alias("zero_target"))


# ---- keys --------------------------------------------------------------------------------------------------
@query(with_(OBS_SQL, """ SELECT off AS "offset", sha256('["' || series || '",' || start_ns || ']') AS stable_key, sha256('["' || series || '",' || start_ns || ',"' || revision || '"]') AS version_key FROM obs"""))
def l6_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One key for what a row is about, one that changes with its revision."""
    head = F.concat(F.lit('["'), F.col("series"), F.lit('",'), F.col("start_ns").cast("string"))
    return observations(spark, sf).select("offset", F.sha2(F.concat(head, F.lit("]")), 256).alias("stable_key"), F.sha2(F.concat(head, F.lit(',"'), F.col("revision"), F.lit('"]')), 256).alias("version_key"))
