"""Queries of policies, contracts and figures in their full form (A3, A15, B8, B15, B18, B21, B22, C3, C5, D4, D8, E5, E6, E12, F3, F9, G2, G3, H6, H9, H13, J1, L1). The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.catalog import GAP_SQL, GRID_SQL, KIND_SQL, PROB_SQL, RET_SQL, SPLITS, T0, H, probabilities, query, with_
from tidemark.functions import expressions as X
from tidemark.operators.asof import as_of_merge
from tidemark.operators import archive, classify, contracts, coverage
from tidemark.sources.scratch import fresh
from tidemark.sources.views import BARS_SQL, OBS_SQL, TICKS_SQL, bars, observations, table, ticks

DAY = X.DAY_NS


# ---- archives ----------------------------------------------------------------------------------------------
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Classified observations in the closed form of a normalized archive."""
    k = classify.linked(classify.classified(observations(spark, sf)))
    given = {
        "producer": F.col("producer").cast("string"), "epoch": F.lit("e1"), "offset": F.col("offset"), "predecessor_epoch": F.when(F.col("predecessor").isNotNull(), "e1"), "predecessor_offset": F.col("predecessor"),
        "raw_sha256": F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("ns").cast("string")), 256), "kind": F.col("kind"), "semantic_revision": F.col("revision"), "normalizer_version": F.lit("n1"), "receipt_wall_time_ns": F.col("ns"),
        "normalized_at_ns": F.col("ns") + 1000, "venue": F.lit("venue"), "category": F.lit("spot"), "symbol": F.col("series"), "start_ns": F.col("start_ns"), "interval_ns": F.lit(6 * H), "close": F.col("price").cast("bigint").cast("string"), "finalized": F.col("finalized"),
        "quality_flags": F.when(F.col("finalized"), F.array(F.lit("final"))).otherwise(F.array().cast("array<string>")),
    }
    return contracts.in_schema(k, given, contracts.NORMALIZED_SCHEMA)


@query(with_(OBS_SQL, KIND_SQL + """ SELECT kind, count(*) AS n, count(DISTINCT revision) AS revisions, count(*) FILTER (WHERE finalized) AS flagged, CAST(48 AS INTEGER) AS n_columns FROM kinds GROUP BY 1"""))
def a3_normalized_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Written by kind, read by its closed schema of 48 columns."""
    path = fresh(spark, "normalized")
    archive.write_once(outcomes(spark, sf), path, ["kind"])
    rows = spark.read.schema(contracts.NORMALIZED_SCHEMA).parquet(path)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("semantic_revision").alias("revisions"), F.count_if(F.array_contains("quality_flags", "final")).alias("flagged")).withColumn("n_columns", F.lit(len(rows.columns)))


@query("""WITH s AS (SELECT l_suppkey AS producer, l_linenumber AS sequence, sum(l_orderkey) AS digest, sum(l_orderkey) FILTER (WHERE l_linenumber <= 3 OR l_returnflag <> 'R') AS before FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN sequence = 7 THEN 'new' WHEN before = digest THEN 'same' ELSE 'conflict' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def a15_import_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of suppliers' lines against a catalog that lacks the seventh and holds later ones without returned lines."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("producer"), F.col("l_linenumber").alias("sequence"))
    incoming = s.agg(F.sum("l_orderkey").alias("digest"))
    known = s.agg(F.sum(F.when((F.col("l_linenumber") <= 3) | (F.col("l_returnflag") != "R"), F.col("l_orderkey"))).alias("digest")).where("sequence < 7")
    return contracts.accepted(incoming, known, ["producer", "sequence"]).groupBy("outcome").agg(F.count("*").alias("n"))


# ---- rules -------------------------------------------------------------------------------------------------
@query("""SELECT page_id, regexp_full_match(coalesce(url, ''), '[A-Za-z0-9][A-Za-z0-9._:/-]*') AND length(url) <= 128 AS identifier, url IS NOT NULL AND page_id % 3 <> 1 AS digest, length(coalesce(html, '')) BETWEEN 1 AND 2000 AS bounded FROM pages""")
def b8_text_rules_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every third page are in capitals, so no digests."""
    sha = F.sha2("url", 256)
    digest = F.when(F.col("page_id") % 3 == 1, F.upper(F.concat(sha, F.lit("a")))).otherwise(sha)
    return table(spark, sf, "pages").select("page_id", X.is_identifier(F.col("url")).alias("identifier"), X.is_digest(digest).alias("digest"), F.coalesce(F.char_length("html").between(1, 2000), F.lit(False)).alias("bounded"))


MODES = [(f, t, c) for f in (True, False) for t in ("exclude", "include") for c in ("exclude", "include")]
MODE_VALUES = ", ".join(f"({str(f).lower()}, '{t}', '{c}')" for f, t, c in MODES)


@query(with_(BARS_SQL, f""", q AS (SELECT finalized, (start_ns // {H}) % 24 <> 11 AS healthy, CASE WHEN (start_ns // {H}) % 24 IN (15, 16) THEN 'pending' WHEN (start_ns // {H}) % 24 = 17 THEN 'unknown' ELSE 'complete' END AS status FROM bars), m(fo, tq, cv) AS (VALUES {MODE_VALUES})
SELECT fo AS finalized_only, tq AS time_quality, cv AS coverage, CASE WHEN fo AND NOT finalized THEN 'not-finalized' WHEN tq = 'exclude' AND NOT healthy THEN 'time-quality' WHEN cv = 'exclude' AND status <> 'complete' THEN 'coverage' END AS reason,
count(*) AS n, count(*) FILTER (WHERE NOT healthy) AS unhealthy, count(*) FILTER (WHERE status <> 'complete') AS uncovered FROM q CROSS JOIN m GROUP BY 1, 2, 3, 4"""))
def b15_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of finality, clock and coverage policies over the candles: first reason against each, null if kept."""
    h = F.expr(f"start_ns div {H} % 24")
    q = bars(spark, sf).select("finalized", (h != 11).alias("healthy"), F.when(h.isin(15, 16), "pending").when(h == 17, "unknown").otherwise("complete").alias("status"))
    out = None
    for finalized_only, time_quality, cover in MODES:
        rows = contracts.policy(q, finalized_only, time_quality, cover).groupBy("reason").agg(F.count("*").alias("n"), F.count_if(~F.col("healthy")).alias("unhealthy"), F.count_if(F.col("status") != "complete").alias("uncovered"))
        rows = rows.select(F.lit(finalized_only).alias("finalized_only"), F.lit(time_quality).alias("time_quality"), F.lit(cover).alias("coverage"), "reason", "n", "unhealthy", "uncovered")
        out = rows if out is None else out.union(rows)
    return out


@query(with_(BARS_SQL, f""", r AS (SELECT series, CASE series WHEN 'view' THEN 'Usd' WHEN 'error' THEN 'usd' ELSE 'usd' END AS unit, (start_ns // {H}) % 24 AS h, n FROM bars)
SELECT series, count(*) AS n, count(*) FILTER (WHERE h = 1) AS bad_hash, count(*) FILTER (WHERE h = 2) AS bad_grid, count(*) FILTER (WHERE h = 3) AS bad_prices, count(*) FILTER (WHERE unit = 'Usd') AS bad_unit, count(*) FILTER (WHERE h = 4) AS bad_decimal, count(*) FILTER (WHERE h = 5) AS bad_label FROM r GROUP BY 1"""))
def b18_dataset_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the dataset's form, broken by their hour, with the violations of each rule."""
    h = F.expr(f"start_ns div {H} % 24")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    rows = bars(spark, sf).select(
        "series", (F.col("start_ns") + F.when(h == 2, 1).otherwise(0)).alias("start_ns"), F.lit(H).alias("interval_ns"), text("open").alias("open"), F.when(h == 3, "-1.00").otherwise(text("high")).alias("high"), text("low").alias("low"),
        F.when(h == 4, F.concat(text("close"), F.lit("1" * 30))).otherwise(text("close")).alias("close"), F.when(F.col("series") == "view", "Usd").otherwise("usd").alias("volume_unit"),
        F.when(h == 1, "abc").otherwise(F.sha2("series", 256)).alias("raw_sha256"), F.when(h == 5, "1.00").alias("label_close"), F.lit(None).cast("bigint").alias("label_end_ns"))
    return contracts.violations(rows, ["series"])


@query("""SELECT doc_id, CASE WHEN lang IS NULL THEN '{"body":{"chars":' || n_chars || ',"lang":null},"id":' || doc_id || ',"tags":["' || source || '","' || doc_id % 3 || '"]}' ELSE '{"body":{"chars":' || n_chars || ',"lang":"' || lang || '\\u00e9"},"id":' || doc_id || ',"tags":["' || source || '","' || doc_id % 3 || '"]}' END AS body FROM documents""")
def b21_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested structs and arrays: names ascending at every level, nulls kept, everything beyond ASCII escaped."""
    d = table(spark, sf, "documents")
    lang = F.concat("lang", F.lit("é"))
    body = contracts.canonical_json(F.struct(F.col("doc_id").alias("id"), F.array("source", (F.col("doc_id") % 3).cast("string")).alias("tags"), F.struct(lang.alias("lang"), F.col("n_chars").alias("chars")).alias("body")), d)
    return d.select("doc_id", body.alias("body"))


@query(with_(BARS_SQL, f""", f AS (SELECT series, start_ns // {DAY} AS day, start_ns, "close", start_ns - lag(start_ns) OVER (PARTITION BY series, start_ns // {DAY} ORDER BY start_ns) AS step, (start_ns // {DAY}) % 7 AS k FROM bars)
SELECT series, day, CASE WHEN k = 3 THEN 'not-finite' WHEN count(*) FILTER (WHERE step <> {H}) > 0 THEN 'timestamps' WHEN count(*) <> 24 THEN 'count' WHEN min(start_ns) <> day * {DAY} THEN 'first' WHEN k = 4 THEN 'quantile-order' ELSE 'ok' END AS state FROM f GROUP BY series, day, k"""))
def b22_forecast_result(spark: SparkSession, sf: str) -> DataFrame:
    """A day as a forecast of 24 hours with quantiles; every seventh day has a value that is not finite, the next crossed quantiles."""
    b = bars(spark, sf).withColumn("day", F.expr(f"start_ns div {DAY}"))
    k, c = F.col("day") % 7, F.col("close")
    rows = b.select("series", "day", "start_ns", F.when((k == 3), F.lit(float("inf"))).otherwise(c).alias("q50"), F.when(k == 4, c + 2).otherwise(c - 1).alias("q10"), (c + 1).alias("q90"))
    return contracts.forecast_checks(rows, ["series", "day"], F.col("day") * DAY, 24, H)


# ---- joins and selection -----------------------------------------------------------------------------------
@query(with_(OBS_SQL, KIND_SQL + """, s AS (SELECT revision, price FROM obs WHERE series <> 'error' GROUP BY 1, 2) SELECT kind, s.revision IS NULL AS missing, count(*) AS n, CAST(sum(s.price) AS BIGINT) AS prices FROM kinds k LEFT JOIN s ON k.revision = s.revision WHERE kind <> 'conflict' GROUP BY 1, 2"""))
def c3_outcome_semantics(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes joined with the store of semantic observations by revision; errors are not in the store."""
    o = observations(spark, sf)
    store = o.where("series <> 'error'").select("revision", F.col("price").cast("bigint").alias("stored")).distinct()
    rows = classify.classified(o).where("kind <> 'conflict'").join(store, "revision", "left")
    return rows.groupBy("kind", F.col("stored").isNull().alias("missing")).agg(F.count("*").alias("n"), F.sum("stored").alias("prices"))


@query(with_(OBS_SQL, f""", k AS (SELECT series, start_ns, off, price, ns + CASE WHEN off % 3 = 0 THEN {8 * H} ELSE 1000 END AS known FROM obs), c AS (SELECT unnest([{T0 + 5 * DAY}, {T0 + 12 * DAY}, {T0 + 20 * DAY}]) AS cutoff)
SELECT cutoff, series, start_ns, arg_max(price, (known, off)) AS price, max((known, off))[2] AS revision_offset FROM k JOIN c ON known <= cutoff GROUP BY 1, 2, 3"""))
def c5_as_of_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Each candle as it was known at three cutoffs; every third revision became known eight hours late."""
    o = observations(spark, sf).select("series", "start_ns", F.col("offset").alias("revision"), F.col("price").cast("bigint").alias("price"), (F.col("ns") + F.when(F.col("offset") % 3 == 0, 8 * H).otherwise(1000)).alias("known"))
    out = as_of_merge(o, [T0 + d * DAY for d in (5, 12, 20)], ["series", "start_ns"], "known", "revision")
    return out.select("cutoff", "series", "start_ns", "price", F.col("revision").alias("revision_offset"))


@query(with_(OBS_SQL, f""", k AS (SELECT series, start_ns, off, price, ns + CASE WHEN off % 3 = 0 THEN {8 * H} ELSE 1000 END AS known FROM obs), c AS (SELECT unnest(range({T0}, {T0 + 30 * DAY}, {6 * H})) AS cutoff),
f AS (SELECT cutoff, series, start_ns, arg_max(price, (known, off)) AS latest, arg_min(price, (known, off)) AS earliest FROM k JOIN c ON known <= cutoff GROUP BY 1, 2, 3)
SELECT cutoff, series, count(*) AS candles, CAST(sum(latest) AS BIGINT) AS latest, CAST(sum(earliest) AS BIGINT) AS first_available FROM f GROUP BY 1, 2"""))
def c5_k8_views_by_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Latest and first available views of all candles at every sixth hour of the month, from one pass each."""
    o = observations(spark, sf).select("series", "start_ns", F.col("offset").alias("revision"), F.col("price").cast("bigint").alias("price"), (F.col("ns") + F.when(F.col("offset") % 3 == 0, 8 * H).otherwise(1000)).alias("known"))
    cutoffs = list(range(T0, T0 + 30 * DAY, 6 * H))
    latest, first = (as_of_merge(o, cutoffs, ["series", "start_ns"], "known", "revision", f) for f in (False, True))
    sums = lambda rows, name: rows.groupBy("cutoff", "series").agg(F.count("*").alias(f"_{name}"), F.sum("price").alias(name))
    return sums(latest, "latest").join(sums(first, "first_available"), ["cutoff", "series"]).select("cutoff", "series", F.col("_latest").alias("candles"), "latest", "first_available")


@query(with_(TICKS_SQL, """, p AS (SELECT producer, CASE WHEN price > 300 THEN off - 400 ELSE off END AS o, off, ns FROM ticks), l AS (SELECT *, lag(o) OVER (PARTITION BY producer ORDER BY ns, off) AS before FROM p)
SELECT producer, off AS arrival, before AS predecessor, o <= before AS falls FROM l"""))
def d4_rising_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Predecessors by arrival; dear ticks come with an old offset, and whether it rises is told."""
    t = ticks(spark, sf).select("producer", F.col("offset").alias("arrival"), "ns", F.when(F.col("price") > 300, F.col("offset") - 400).otherwise(F.col("offset")).alias("offset"))
    return classify.risen(t, ["producer"], ["ns", "arrival"]).select("producer", "arrival", "predecessor", "falls")


@query(with_(OBS_SQL, KIND_SQL + """, t AS (SELECT series, start_ns, off, producer, finalized, CASE WHEN kind = 'duplicate' AND price >= 100 THEN 'accepted' WHEN kind = 'accepted' AND off % 5 = 0 THEN 'open_revision' ELSE kind END AS kind FROM kinds),
v AS (SELECT *, min(producer) OVER k <> max(producer) OVER k AS several, row_number() OVER (PARTITION BY series, start_ns, kind ORDER BY off) AS nth, row_number() OVER (PARTITION BY series, start_ns ORDER BY off) AS place,
  coalesce(bool_or(finalized AND kind <> 'conflict') OVER (PARTITION BY series, start_ns ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM t WINDOW k AS (PARTITION BY series, start_ns)),
r AS (SELECT *, CASE WHEN kind = 'conflict' THEN 'conflict-input' WHEN kind = 'accepted' AND nth > 1 THEN 'repeated-accepted' WHEN kind IN ('open_revision', 'finalization') AND place = 1 THEN 'no-predecessor' WHEN kind IN ('open_revision', 'finalization') AND done THEN 'change-after-final' WHEN several AND place = 1 THEN 'mixed-producer' END AS reason FROM v)
SELECT series, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2"""))
def d8_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """A tampered history: dear repeats stand as accepted, some first ones as revisions; every rule has rows."""
    k = classify.classified(observations(spark, sf))
    kind = F.when((F.col("kind") == "duplicate") & (F.col("price") >= 100), "accepted").when((F.col("kind") == "accepted") & (F.col("offset") % 5 == 0), "open_revision").otherwise(F.col("kind"))
    return classify.transitions(k.withColumn("kind", kind)).groupBy("series", "reason").agg(F.count("*").alias("n"))


# ---- figures -----------------------------------------------------------------------------------------------
QUANTILES = {"q025": (0.025, -0.9), "q10": (0.1, -0.5), "q50": (0.5, 0.0), "q90": (0.9, 0.5), "q975": (0.975, 0.9)}
FIVE_SQL = PROB_SQL + ", five AS (SELECT *, 0.1 * tanh(prediction) - 0.9 AS x025, 0.1 * tanh(prediction) - 0.5 AS x10, 0.1 * tanh(prediction) AS x50, 0.1 * tanh(prediction) + 0.5 AS x90, 0.1 * tanh(prediction) + 0.9 AS x975 FROM q)"


def five_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return probabilities(spark, sf).withColumns({f"x{n[1:]}": 0.1 * F.tanh("prediction") + shift for n, (_, shift) in QUANTILES.items()})


def pinball_sql(q: float, c: str) -> str:
    return f"round(avg(greatest({q} * (target - {c}), {q - 1} * (target - {c}))), 8)"


@query(with_(BARS_SQL, FIVE_SQL + f""" SELECT series, count(*) AS n, {pinball_sql(0.025, 'x025')} AS pinball_025, {pinball_sql(0.1, 'x10')} AS pinball_10, {pinball_sql(0.5, 'x50')} AS pinball_50, {pinball_sql(0.9, 'x90')} AS pinball_90, {pinball_sql(0.975, 'x975')} AS pinball_975,
round(avg(CAST(target BETWEEN x10 AND x90 AS INTEGER)), 8) AS coverage_80, round(avg(CAST(target BETWEEN x025 AND x975 AS INTEGER)), 8) AS coverage_95, round(avg(x90 - x10), 8) AS width_80, round(avg(x975 - x025), 8) AS width_95 FROM five GROUP BY 1"""))
def e5_five_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Pinball losses of five quantiles, coverage and width of the 80 and 95 % bands."""
    rows = five_quantiles(spark, sf)
    return contracts.band_scores(rows, ["series"], {f"x{n[1:]}": q for n, (q, _) in QUANTILES.items()}, {"80": ("x10", "x90"), "95": ("x025", "x975")})


@query(with_(BARS_SQL, FIVE_SQL + f""" SELECT series, start_ns // {DAY} AS day, count(*) AS n, round(sum(abs(prediction - target)), 6) AS abs_loss, round(sum((prediction - target) ** 2), 6) AS sq_loss, count(*) FILTER (WHERE target BETWEEN x10 AND x90) AS covered_80, count(*) FILTER (WHERE target BETWEEN x025 AND x975) AS covered_95,
round(sum(x90 - x10), 6) AS width_80, round(sum(x975 - x025), 6) AS width_95, count(*) FILTER (WHERE target <> 0) AS n_binary FROM five GROUP BY 1, 2"""))
def e6_daily_sums(spark: SparkSession, sf: str) -> DataFrame:
    x = {n: 0.1 * F.tanh("prediction") + shift for n, (_, shift) in QUANTILES.items()}
    rows = probabilities(spark, sf).withColumns({f"x{n[1:]}": c for n, c in x.items()})
    e, t = F.col("prediction") - F.col("target"), F.col("target")
    return rows.groupBy("series", F.expr(f"start_ns div {DAY}").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.abs(e)), 6).alias("abs_loss"), F.round(F.sum(e * e), 6).alias("sq_loss"), F.count_if(t.between(F.col("x10"), F.col("x90"))).alias("covered_80"), F.count_if(t.between(F.col("x025"), F.col("x975"))).alias("covered_95"),
        F.round(F.sum(F.col("x90") - F.col("x10")), 6).alias("width_80"), F.round(F.sum(F.col("x975") - F.col("x025")), 6).alias("width_95"), F.count_if(t != 0).alias("n_binary"))


@query(with_(TICKS_SQL, f""", t AS (SELECT series, count(*) AS records, sum(length(CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR)) + 60) AS logical, sum(length(CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR)) + 60 + length(series)) AS encoded, (max(ns) - min(ns)) / {DAY}.0 AS days FROM ticks GROUP BY 1)
SELECT series, records, CAST(logical AS BIGINT) AS logical_bytes, CAST(encoded AS BIGINT) AS encoded_bytes, round(records / days, 6) AS records_a_day, round(90 * encoded / days / 1073741824.0, 9) AS gib_90_days, round(1.3 * 90 * encoded / days / 1073741824.0, 9) AS disk_90_days FROM t"""))
def e12_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Volume by family and the disk that 90 days of it need, with 30 % to spare."""
    size = F.char_length(F.col("price").cast("decimal(18,2)").cast("string")) + 60
    t = ticks(spark, sf).withColumns({"logical": size, "encoded": size + F.char_length("series")})
    return contracts.capacity(t, ["series"], 90, 1.3)


@query(with_(BARS_SQL, f""", b2 AS (SELECT *, sha256(series || '|' || start_ns || '|' || off) AS fp FROM bars), n AS (SELECT a.series, a.start_ns, b1.fp AS o1, b2.fp AS o2, b3.fp AS o3, b1.finalized AS f1, b2.finalized AS f2 FROM bars a
LEFT JOIN b2 b1 ON b1.series = a.series AND b1.start_ns = a.start_ns + {H} LEFT JOIN b2 b2 ON b2.series = a.series AND b2.start_ns = a.start_ns + {2 * H} LEFT JOIN b2 b3 ON b3.series = a.series AND b3.start_ns = a.start_ns + {3 * H}),
v AS (SELECT series, start_ns, o1, CASE WHEN f1 THEN o2 END AS o2, CASE WHEN f1 AND f2 THEN o3 END AS o3 FROM n) SELECT series, start_ns, sha256(concat_ws(',', o1, o2, o3)) AS lineage_sha256 FROM v"""))
def f3_fingerprint_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of fingerprints that a label visited, up to the first open or missing bar, as one hash."""
    fp = F.sha2(F.concat_ws("|", "series", F.col("start_ns").cast("string"), F.col("offset").cast("string")), 256)
    return contracts.fingerprint_chain(bars(spark, sf).withColumn("fp", fp), 3, H)


F9_SQL = RET_SQL + f""", d AS (SELECT series, start_ns // {DAY} AS day, avg(target) AS r, avg(abs(target)) AS a FROM p GROUP BY 1, 2 HAVING count(*) >= 12),
m AS (SELECT series, count(*) AS n, avg(r) AS mr, avg(a) AS ma, sum(r * r) - count(*) * avg(r) * avg(r) AS vr, sum(a * a) - count(*) * avg(a) * avg(a) AS va FROM d GROUP BY 1),
k AS (SELECT x.series, y.day - x.day AS lag, sum((x.r - mr) * (y.r - mr)) / any_value(vr) AS acf, sum((x.a - ma) * (y.a - ma)) / any_value(va) AS acf_abs, any_value(n) AS n FROM d x JOIN d y ON x.series = y.series AND y.day > x.day AND y.day <= x.day + 112 JOIN m ON m.series = x.series GROUP BY 1, 2)"""


@query(with_(BARS_SQL, F9_SQL + """ SELECT series, lag, round(acf, 6) AS acf, round(acf_abs, 6) AS acf_abs, CAST(max(CASE WHEN abs(acf) > 2 / sqrt(n) OR abs(acf_abs) > 2 / sqrt(n) THEN lag END) OVER (PARTITION BY series) + 1 AS BIGINT) AS span FROM k"""))
def f9_dependence_span(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation of daily mean and mean absolute returns at up to 112 lags, and the span of dependence behind the last significant one."""
    from tidemark.catalog import returns

    d = returns(spark, sf).groupBy("series", F.expr(f"start_ns div {DAY}").alias("day")).agg(F.avg("target").alias("r"), F.avg(F.abs("target")).alias("a"), F.count("*").alias("n")).where("n >= 12").drop("n")
    return contracts.dependence(d, 112)


@query(with_(TICKS_SQL, f""", p AS (SELECT series, off, ns, lag(off) OVER (PARTITION BY series ORDER BY off) AS before FROM ticks), a AS (SELECT series, max(off) AS anchor FROM ticks WHERE ns < {SPLITS[0][2]} GROUP BY 1),
r AS (SELECT p.*, anchor, row_number() OVER (PARTITION BY p.series ORDER BY off) AS k FROM p JOIN a ON a.series = p.series AND off > anchor) SELECT series, off AS "offset", before, coalesce(lag(off) OVER (PARTITION BY series ORDER BY off), anchor) = before AS continuous FROM r WHERE k <= 50"""))
def g2_anchored_page(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 manifests behind each series' anchor checkpoint, each following from the one before, the first from the anchor."""
    t = ticks(spark, sf)
    anchor = t.where(F.col("ns") < SPLITS[0][2]).groupBy("series").agg(F.max("offset").alias("anchor"))
    chain = t.withColumn("before", F.lag("offset").over(W.partitionBy("series").orderBy("offset"))).select("series", "offset", "before")
    return contracts.page_after(chain, anchor, 50)


@query(with_(BARS_SQL, """, s AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS pos FROM (SELECT DISTINCT series FROM bars)) SELECT series, start_ns, row_number() OVER (ORDER BY start_ns, pos <= 2, pos) AS turn FROM bars JOIN s USING (series) ORDER BY turn LIMIT 500"""))
def g3_maturation_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 maturations: hour by hour, series in turn, those behind the cursor (the third) first."""
    b = bars(spark, sf).select("series", "start_ns")
    names = b.select("series").distinct()
    pos = names.withColumn("pos", F.row_number().over(W.orderBy("series")) - 1)  # a row an instrument
    return contracts.round_robin(b.join(F.broadcast(pos), "series"), 2, 500)


# ---- coverage ----------------------------------------------------------------------------------------------
@query(with_(BARS_SQL, GAP_SQL + f""", w AS (SELECT series, gap_start, gap_end, unnest(range(gap_start, gap_end, {H})) AS start_ns FROM gaps WHERE gap_end > gap_start), proven AS (SELECT series, start_ns FROM bars WHERE NOT finalized UNION SELECT series, gap_start FROM gaps WHERE gap_end > gap_start AND series <> 'view'),
r AS (SELECT w.series, gap_start, gap_end, count(*) AS expected, count(b.start_ns) AS proven FROM w LEFT JOIN proven b ON b.series = w.series AND b.start_ns = w.start_ns GROUP BY 1, 2, 3)
SELECT *, CASE WHEN expected = proven THEN 'complete' WHEN series IN ('click', 'view') THEN 'unknown' ELSE 'pending' END AS state FROM r"""))
def h6_repair_states(spark: SparkSession, sf: str) -> DataFrame:
    """Backfill proved open bars and first hours of gaps; the source of clicks and views is exhausted."""
    b = bars(spark, sf)
    gaps = coverage.candle_gaps(b)
    proven = b.where(~F.col("finalized")).select("series", "start_ns").union(gaps.where("series <> 'view'").select("series", "gap_start")).distinct()
    spent = F.col("series").isin("click", "view")
    return coverage.repair(gaps.where(spent), proven, True).union(coverage.repair(gaps.where(~spent), proven, False))


@query(with_(TICKS_SQL, f""", s AS (SELECT series, ns // {3 * DAY} AS session, min(ns) AS a, max(ns) FILTER (WHERE price >= 10) AS c FROM ticks GROUP BY 1, 2)
SELECT series AS stream, session, coalesce(c, a) AS gap_start, lead(a) OVER (PARTITION BY series ORDER BY a, session) AS gap_end, CASE WHEN lead(a) OVER (PARTITION BY series ORDER BY a, session) IS NULL THEN 'open' ELSE 'closed' END AS state FROM s"""))
def h9_checkpoint_restarts(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown from the last checkpoint of a session (cheap ticks are never checkpointed) to the first message of the next; the last span is open."""
    t = ticks(spark, sf).select(F.col("series").alias("stream"), F.expr(f"ns div {3 * DAY}").alias("session"), "ns", (F.col("price") >= 10).alias("checkpoint"))
    return contracts.restarts(t)


@query(with_(TICKS_SQL, f""", st AS (SELECT series, max(ns) AS last_ns, count(*) AS received, count(*) FILTER (WHERE off % 50 <> 7) AS committed, count(*) FILTER (WHERE off % 50 <> 7 AND price >= 5) AS normalized, count(*) FILTER (WHERE off % 50 <> 7 AND price >= 5 AND ns < {SPLITS[2][1]}) AS published FROM ticks GROUP BY 1)
SELECT series, last_ns, {T0 + 720 * H} - last_ns AS age_ns, {T0 + 720 * H} - last_ns > 600000000000 AS stale, received, committed, normalized, published, received - published AS lag FROM st"""))
def h13_pipeline_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Freshness and how many messages of each stream passed the stages by the as-of."""
    t = ticks(spark, sf)
    committed = t.where("offset % 50 <> 7")
    normalized = committed.where("price >= 5")
    stages = {"received": t, "committed": committed, "normalized": normalized, "published": normalized.where(F.col("ns") < SPLITS[2][1])}
    return contracts.pipeline_lag(stages, T0 + 720 * H, 600_000_000_000)


@query(with_(BARS_SQL, GRID_SQL + f""", kn AS (SELECT d.*, start_ns + {H} + CASE (start_ns // {H}) % 24 WHEN 7 THEN {2 * H} ELSE 1000 END AS known FROM dense d),
o AS (SELECT a.series, a.start_ns + {H} AS origin_ns, arg_min(coalesce(x.bad, CASE WHEN x.known > a.start_ns + {H} + 60000000000 THEN 'not-yet-known' END), x.start_ns) FILTER (WHERE x.bad IS NOT NULL OR x.known > a.start_ns + {H} + 60000000000) AS reason, count(*) AS n
FROM kn a JOIN kn x ON x.series = a.series AND x.start_ns BETWEEN a.start_ns - {11 * H} AND a.start_ns GROUP BY 1, 2) SELECT series, CASE WHEN n < 12 THEN 'missing-history-boundary' ELSE coalesce(reason, 'eligible') END AS state, count(*) AS n FROM o GROUP BY 1, 2"""))
def j1_known_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins by what was known a minute behind them: hours of seven come two hours late."""
    h = F.expr(f"start_ns div {H} % 24")
    b = bars(spark, sf).select("series", "start_ns", "finalized", (F.col("start_ns") + H + F.when(h == 7, 2 * H).otherwise(1000)).alias("known_ns"))
    return contracts.known_origins(b, 12, 60_000_000_000).groupBy("series", F.coalesce("reason", F.lit("eligible")).alias("state")).agg(F.count("*").alias("n"))


@query(with_(OBS_SQL, KIND_SQL + """ SELECT off AS "offset", sha256('{"outcome":{"kind":"' || kind || '","revision":"' || revision || '"},"raw":{"ns":' || ns || ',"offset":' || off || ',"producer":' || producer || '},"semantics":{"close":' || price || ',"finalized":' || finalized || ',"start_ns":' || start_ns || '}}') AS fingerprint FROM kinds"""))
def l1_outcome_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Raw message, outcome and semantics under one hash of their canonical JSON."""
    k = classify.classified(observations(spark, sf))
    body = F.to_json(F.struct(F.struct("kind", "revision").alias("outcome"), F.struct("ns", "offset", "producer").alias("raw"), F.struct(F.col("price").cast("bigint").alias("close"), "finalized", "start_ns").alias("semantics")), {"ignoreNullFields": "false"})
    return k.select("offset", F.sha2(body, 256).alias("fingerprint"))
