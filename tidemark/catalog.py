"""All queries over the driver tables, with the SQL that checks them.

Names begin with the id of the operator in the blueprint. Each query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import expressions as X
from tidemark.operators import classify, coverage, derive, ledger, scores
from tidemark.sources.views import BARS_SQL, OBS_SQL, TICKS_SQL, bars, candles, observations, table, ticks

FLAGSHIP = "m0_forecast_scores"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
H = X.HOUR_NS
#: 2024-01-01 UTC, the first day of the events.
T0 = 1_704_067_200_000_000_000
SPLITS = [("train", T0, T0 + 18 * 24 * H), ("validation", T0 + 18 * 24 * H, T0 + 24 * 24 * H), ("test", T0 + 24 * 24 * H, T0 + 31 * 24 * H)]


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def with_(base: str, rest: str) -> str:
    return f"WITH {base}{rest}"


# ---- M0: the flagship --------------------------------------------------------------------------------------
LABEL_SQL = f""",
g AS (SELECT *, row_number() OVER w AS rn, lag(start_ns, 2) OVER w AS l_start, lag("close", 2) OVER w AS l_close,
  lead(start_ns, 1) OVER w AS s1, lead(start_ns, 2) OVER w AS s2, lead(start_ns, 3) OVER w AS s3,
  lead(finalized, 1) OVER w AS f1, lead(finalized, 2) OVER w AS f2, lead(finalized, 3) OVER w AS f3, lead("close", 3) OVER w AS c3
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY start_ns)),
lab AS (SELECT series, start_ns, "close", finalized, CASE WHEN start_ns - l_start = {2 * H} THEN l_close END AS lag_close,
  CASE WHEN start_ns - l_start = {2 * H} THEN NULL ELSE 'gap-or-missing' END AS lag_reason,
  CASE WHEN s1 IS NULL OR s1 <> start_ns + {H} THEN 'gap-or-missing' WHEN NOT f1 THEN 'not-finalized'
       WHEN s2 IS NULL OR s2 <> start_ns + {2 * H} THEN 'gap-or-missing' WHEN NOT f2 THEN 'not-finalized'
       WHEN s3 IS NULL OR s3 <> start_ns + {3 * H} THEN 'gap-or-missing' WHEN NOT f3 THEN 'not-finalized' END AS label_reason, c3
  FROM g)"""


@query(with_(BARS_SQL, LABEL_SQL + f""",
c AS (SELECT series, CASE WHEN start_ns >= {SPLITS[0][1]} AND start_ns + {4 * H} < {SPLITS[0][2]} THEN 'train'
   WHEN start_ns >= {SPLITS[1][1]} AND start_ns + {4 * H} < {SPLITS[1][2]} THEN 'validation'
   WHEN start_ns >= {SPLITS[2][1]} AND start_ns + {4 * H} < {SPLITS[2][2]} THEN 'test' END AS part, "close" - c3 AS e
  FROM lab WHERE lag_reason IS NULL AND label_reason IS NULL)
SELECT series, part AS "partition", count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias
FROM c WHERE part IS NOT NULL GROUP BY 1, 2"""))  # fmt: skip
def m0_forecast_scores(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_scores(bars(spark, sf))


def pooled_forecast_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same over one instrument made of all ticks, which has whole chains on small tables too."""
    return forecast_scores(candles(ticks(spark, sf).withColumn("series", F.lit("all"))))


def forecast_scores(candle: DataFrame) -> DataFrame:
    rows = derive.lag_label(candle).where("lag_reason is null and label_reason is null")
    rows = rows.withColumn("partition", scores.partition_of(F.col("start_ns"), F.col("label_end_ns"), SPLITS)).where("partition is not null")
    return scores.point_metrics(rows.withColumns({"prediction": F.col("close"), "target": F.col("label_close")}), ["series", "partition"])


# ---- sources and scalar rules ------------------------------------------------------------------------------
@query("""SELECT doc_id, octet_length(encode(text)) AS logical_bytes, sha256(text) AS content_sha256, lang IS DISTINCT FROM 'fr' AS verified FROM documents WHERE text IS NOT NULL""")
def a1_verified_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads against the hash stored beside them; French ones have gained a character since."""
    d = table(spark, sf, "documents").where("text is not null")
    stored = d.select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.octet_length("text").cast("bigint").alias("logical_bytes"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"))
    return stored.select("doc_id", "logical_bytes", "content_sha256", (F.sha2("payload", 256) == F.col("content_sha256")).alias("verified"))


@query(with_(TICKS_SQL, " SELECT series, off AS \"offset\", price FROM ticks WHERE off > 500 ORDER BY off LIMIT 200"))
def a10_incremental_read(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where("offset > 500").orderBy("offset").limit(200).select("series", "offset", "price")


@query(with_(TICKS_SQL, " SELECT producer, off AS arrival, row_number() OVER (PARTITION BY producer ORDER BY ns, off) AS \"offset\" FROM ticks"))
def a11_assign_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).select("producer", F.col("offset").alias("arrival"), F.row_number().over(W.partitionBy("producer").orderBy("ns", "offset")).cast("bigint").alias("offset"))


@query("""SELECT CASE WHEN c.orders_n IS NULL THEN 'new' WHEN l.n = c.orders_n THEN 'same' ELSE 'conflict' END AS outcome, count(*) AS n
FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l LEFT JOIN (SELECT o_orderkey AS k, 1 + o_orderkey % 7 AS orders_n FROM orders WHERE o_orderstatus <> 'O') c USING (k) GROUP BY 1""")
def a15_catalog_accept(spark: SparkSession, sf: str) -> DataFrame:
    incoming = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    known = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 7).alias("known"))
    rows = incoming.join(known, "k", "left")
    return rows.groupBy(F.when(F.col("known").isNull(), "new").when(F.col("n") == F.col("known"), "same").otherwise("conflict").alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events)
SELECT CASE WHEN NOT ok THEN 'malformed-json' WHEN json_type(props) <> 'OBJECT' THEN 'not-an-object' ELSE 'accepted' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def b2_payload_reasons(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").select("props", F.try_parse_json("props").alias("v"))
    reason = F.when(F.col("v").isNull(), "malformed-json").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not-an-object").otherwise("accepted")
    return v.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS text,
regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS canonical FROM orders""")
def b4_canonical_decimal(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"), X.canonical_decimal(text).alias("canonical"))


@query(with_(OBS_SQL, ' SELECT off AS "offset", revision FROM obs'))
def b5_semantic_revision(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).select("offset", "revision")


@query(with_(BARS_SQL, ' SELECT series, start_ns, low >= 0 AND low <= least(open, "close") AND greatest(open, "close") <= high AS consistent FROM bars'))
def b6_ohlc_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("series", "start_ns", X.ohlc_consistent(F.col("open"), F.col("high"), F.col("low"), F.col("close")).alias("consistent"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 END AS source_ns FROM events""")
def b7_source_ns(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 4).alias("k"))
    unit = F.when(F.col("k") == 0, "s").when(F.col("k") == 1, "ms").when(F.col("k") == 2, "us").otherwise("ns")
    value = F.when(unit == "s", F.expr("us div 1000000")).when(unit == "ms", F.expr("us div 1000")).when(unit == "us", F.col("us")).otherwise(F.col("us") * 1000)
    return e.select("event_id", X.source_ns(value, unit).alias("source_ns"))


CLOCK = "SELECT *, CASE WHEN off % 11 = 0 THEN 'stale' ELSE 'healthy' END AS status, off % 13 * 1000 AS clock_offset, off % 29 * 1000 AS unc, off % 7 * 1000000000 AS age FROM ticks"


@query(with_(TICKS_SQL, f""", c AS ({CLOCK}), i AS (SELECT *, CASE WHEN status = 'healthy' AND unc <= 25000 AND unc >= abs(clock_offset) + CAST(ceil(age * 200 / 1000000000) AS BIGINT) THEN 1 END AS fit FROM c)
SELECT off AS "offset", CASE WHEN fit = 1 THEN ns - unc END AS lo, CASE WHEN fit = 1 THEN ns + unc END AS hi,
coalesce(fit = 1 AND ns + unc <= {T0 + 15 * 24 * H} - 1000, false) AS observed, coalesce(fit = 1 AND ns - unc > {T0 + 10 * 24 * H}, false) AS final FROM i"""))
def b9_clock_intervals(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    o = F.col("offset")
    iv = X.time_interval(F.col("ns"), F.when(o % 11 == 0, "stale").otherwise("healthy"), o % 13 * 1000, o % 29 * 1000, o % 7 * 1_000_000_000, 25_000, 200)
    cutoff = F.struct(F.lit(T0 + 15 * 24 * H - 1000).alias("lo"), F.lit(T0 + 15 * 24 * H + 1000).alias("hi"))
    t = t.withColumn("iv", iv)
    return t.select("offset", "iv.lo", "iv.hi", X.observed_by(F.col("iv"), cutoff).alias("observed"), X.is_final(F.col("iv"), F.lit(T0 + 10 * 24 * H)).alias("final"))


@query(with_(TICKS_SQL, """ SELECT off AS "offset", CASE WHEN off % 17 = 0 THEN 'clock-discontinuity' WHEN off % 5 = 0 THEN 'unknown'
WHEN ns + 5000 <= ns - ns % 3600000000000 + 1800000000000 THEN 'on-time' WHEN ns - 5000 > ns - ns % 3600000000000 + 1800000000000 THEN 'late' ELSE 'uncertain' END AS timeliness FROM ticks"""))
def b12_timeliness(spark: SparkSession, sf: str) -> DataFrame:
    o, ns = F.col("offset"), F.col("ns")
    iv = F.when(o % 5 != 0, F.struct((ns - 5000).alias("lo"), (ns + 5000).alias("hi")))
    return ticks(spark, sf).select("offset", X.timeliness(iv, iv, F.lit("a"), F.when(o % 17 == 0, "b").otherwise("a"), ns - F.pmod(ns, F.lit(H)) + H // 2).alias("timeliness"))


@query(with_(TICKS_SQL, " SELECT series, strftime(make_timestamp(ns // 1000), '%Y-%m-%d') AS utc_date, count(*) AS n FROM ticks GROUP BY 1, 2"))
def b13_utc_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).groupBy("series", X.utc_date(F.col("ns")).alias("utc_date")).agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') GROUP BY 1""")
def b16_source_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that have no grant: a non-empty result denies the build."""
    grants = spark.createDataFrame([(f"src{i}", i < 4) for i in range(8)], "source string, permitted boolean").where("permitted")
    return table(spark, sf, "documents").join(F.broadcast(grants), "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || repeat('1', CAST(l_linenumber * 3 AS INTEGER)) AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, length(split_part(text, '.', 1)) <= 20 AND length(rtrim(split_part(text, '.', 2), '0')) <= 18 AS fits FROM t""")
def b19_decimal_fit(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.expr("repeat('1', l_linenumber * 3)"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.fits_decimal(text).alias("fits"))


# ---- joins -------------------------------------------------------------------------------------------------
@query("""SELECT n_name, count(*) AS n, count(*) FILTER (WHERE c.c_custkey IS NULL) AS missing FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'AUTOMOBILE') c ON o.o_custkey = c.c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def c1_metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment <> 'AUTOMOBILE'")
    rows = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("missing"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey % 5 AS h FROM orders WHERE o_orderstatus <> 'P'), u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey % 5 END AS h FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT CASE WHEN u.k IS NULL THEN 'no-outcome' WHEN r.k IS NULL THEN 'no-raw' WHEN r.h <> u.h THEN 'hash-mismatch' ELSE 'ok' END AS state, count(*) AS n FROM r FULL JOIN u ON r.k = u.k GROUP BY 1""")
def c2_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    raw = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("h"), F.lit(True).alias("raw"))
    out = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(F.col("o_custkey") % 5).alias("g"), F.lit(True).alias("out"))
    state = F.when(F.col("out").isNull(), "no-outcome").when(F.col("raw").isNull(), "no-raw").when(F.col("h") != F.col("g"), "hash-mismatch").otherwise("ok")
    return raw.join(out, "k", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


CLAIMS = f"SELECT series, start_ns AS claim_start, start_ns + {5 * H} AS claim_end, CASE WHEN n % 4 = 0 THEN 'pending' WHEN n % 11 = 0 THEN 'unrecoverable' ELSE 'complete' END AS status FROM bars WHERE start_ns % {3 * H} = 0"
SPANS = f"SELECT series, start_ns AS span_start, start_ns + {2 * H} AS span_end FROM bars WHERE start_ns % {7 * H} = 0"


def claims_of(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("n") % 4 == 0, "pending").when(F.col("n") % 11 == 0, "unrecoverable").otherwise("complete")
    claims = b.where(F.col("start_ns") % (3 * H) == 0).select("series", F.col("start_ns").alias("claim_start"), (F.col("start_ns") + 5 * H).alias("claim_end"), status.alias("status"))
    spans = b.where(F.col("start_ns") % (7 * H) == 0).select("series", F.col("start_ns").alias("span_start"), (F.col("start_ns") + 2 * H).alias("span_end"))
    return spans, claims


@query(with_(BARS_SQL, f", c AS ({CLAIMS}), s AS ({SPANS}) SELECT s.series, span_start, count(*) AS n, count(DISTINCT status) AS kinds FROM s JOIN c ON s.series = c.series AND span_start < claim_end AND claim_start < span_end GROUP BY 1, 2"))
def c4_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.overlapping(*claims_of(bars(spark, sf))).groupBy("series", "span_start").agg(F.count("*").alias("n"), F.count_distinct("status").alias("kinds"))


@query(with_(OBS_SQL, f' SELECT series, start_ns, arg_max(price, off) AS price, max(off) AS revision_offset FROM obs WHERE ns <= start_ns + {4 * H} GROUP BY 1, 2'))
def c5_as_of(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf).select("series", "start_ns", F.col("offset").alias("revision"), "ns", F.col("price").cast("bigint").alias("price"), F.col("offset").alias("known"))
    out = scores.as_of(o.where(F.col("ns") <= F.col("start_ns") + 4 * H), ["series", "start_ns"], "known", F.lit(2**62))
    return out.select("series", "start_ns", "price", F.col("revision").alias("revision_offset"))


# ---- classification ----------------------------------------------------------------------------------------
KIND_SQL = """,
k0 AS (SELECT *, row_number() OVER (PARTITION BY series, start_ns, revision ORDER BY off) AS rn, count(*) OVER w AS before, coalesce(bool_or(finalized) OVER w, false) AS was_final
  FROM obs WINDOW w AS (PARTITION BY series, start_ns ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN before = 0 THEN 'accepted' WHEN was_final THEN 'conflict' WHEN finalized THEN 'finalization' ELSE 'open_revision' END AS kind FROM k0)"""


@query(with_(OBS_SQL, KIND_SQL + ' SELECT series, start_ns, off AS "offset", kind FROM kinds'))
def d1_classify(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classified(observations(spark, sf)).select("series", "start_ns", "offset", "kind")


@query(with_(OBS_SQL, """, p AS (SELECT *, min(off) FILTER (WHERE off % 97 = 0) OVER (PARTITION BY producer) AS bar FROM obs)
SELECT producer, CASE WHEN bar IS NULL OR off < bar THEN 'processable' ELSE 'pending' END AS state, count(*) AS n FROM p GROUP BY 1, 2"""))
def d3_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return classify.barred(observations(spark, sf), F.col("offset") % 97 == 0).groupBy("producer", "state").agg(F.count("*").alias("n"))


@query(with_(TICKS_SQL, ' SELECT producer, off AS "offset", lag(off) OVER (PARTITION BY producer ORDER BY off) AS predecessor FROM ticks'))
def d4_predecessor(spark: SparkSession, sf: str) -> DataFrame:
    return classify.linked(ticks(spark, sf)).select("producer", "offset", "predecessor")


def _select_sql(fn: str) -> str:
    return f""" SELECT series, start_ns, CAST({fn}(price, off) FILTER (WHERE good) AS BIGINT) AS price, {fn}(finalized, off) FILTER (WHERE good) AS finalized, {fn}(off, off) FILTER (WHERE good) AS "offset", count(*) AS n_evidence, string_agg(CAST(off AS VARCHAR), ',' ORDER BY off) AS evidence
FROM (SELECT *, kind IN ('accepted', 'open_revision', 'finalization') AS good FROM kinds) GROUP BY 1, 2 HAVING bool_or(good)"""


def _selected(spark: SparkSession, sf: str, which: str) -> DataFrame:
    out = classify.selected(classify.classified(observations(spark, sf)), which)
    return out.select("series", "start_ns", F.col("price").cast("bigint").alias("price"), "finalized", "offset", F.col("n_evidence").cast("bigint").alias("n_evidence"), "evidence")


@query(with_(OBS_SQL, KIND_SQL + _select_sql("arg_max")))
def d5_select_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, "latest")


@query(with_(OBS_SQL, KIND_SQL + _select_sql("arg_min")))
def d6_select_first(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, "first")


@query(with_(TICKS_SQL, f" SELECT coalesce(CASE WHEN ns + 1000000 <= {T0 + 12 * 24 * H} THEN 'kept' END, 'not_proven_before_cutoff') AS state, count(*) AS n FROM ticks GROUP BY 1"))
def d7_as_observed(spark: SparkSession, sf: str) -> DataFrame:
    kept, out = classify.as_observed(ticks(spark, sf), T0 + 12 * 24 * H, 1_000_000)
    return kept.select(F.lit("kept").alias("state")).union(out.select("reason")).groupBy("state").agg(F.count("*").alias("n"))


@query(with_(OBS_SQL, KIND_SQL + """, v AS (SELECT *, min(producer) OVER k <> max(producer) OVER k AS several FROM kinds WINDOW k AS (PARTITION BY series, start_ns))
SELECT series, start_ns, off AS "offset", CASE WHEN kind = 'conflict' THEN 'conflict-input' WHEN several AND kind = 'accepted' THEN 'mixed-producer' END AS reason FROM v WHERE kind = 'conflict' OR several AND kind = 'accepted'"""))
def d8_violations(spark: SparkSession, sf: str) -> DataFrame:
    return classify.violations(classify.classified(observations(spark, sf)))


@query(with_(OBS_SQL, " SELECT series, start_ns, count(DISTINCT revision) AS n_revisions, min(off) AS first_offset FROM obs WHERE finalized GROUP BY 1, 2 HAVING count(DISTINCT revision) > 1"))
def d10_final_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.final_conflicts(observations(spark, sf))


# ---- aggregations ------------------------------------------------------------------------------------------
@query(with_(OBS_SQL, KIND_SQL + " SELECT series, count(*) AS n, min(off) AS first_offset, max(off) AS last_offset, min(ns) AS first_ns, max(ns) AS last_ns, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM kinds GROUP BY 1"))
def e1_snapshot_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = classify.classified(observations(spark, sf))
    return k.groupBy("series").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"), F.concat_ws(",", F.sort_array(F.collect_set("kind"))).alias("kinds"))


@query(with_(BARS_SQL, LABEL_SQL + " SELECT series, coalesce(lag_reason, label_reason, 'kept') AS reason, count(*) AS n FROM lab GROUP BY 1, 2"))
def e2_exclusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return derive.lag_label(bars(spark, sf)).groupBy("series", F.coalesce("lag_reason", "label_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


RET_SQL = f""", p AS (SELECT b.series, b.start_ns, ln(b."close") - ln(a."close") AS prediction, ln(c."close") - ln(b."close") AS target FROM bars b JOIN bars a ON a.series = b.series AND a.start_ns = b.start_ns - {H} JOIN bars c ON c.series = b.series AND c.start_ns = b.start_ns + {H})"""


def returns(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("series", F.pmod("start_ns", F.lit(H))).orderBy("start_ns")
    b = bars(spark, sf).select("series", "start_ns", "close", F.lag("close").over(w).alias("a"), F.lead("close").over(w).alias("c"), F.lag("start_ns").over(w).alias("s"), F.lead("start_ns").over(w).alias("e"))
    b = b.where((F.col("start_ns") - F.col("s") == H) & (F.col("e") - F.col("start_ns") == H))
    return b.select("series", "start_ns", X.log_return(F.col("close"), F.col("a")).alias("prediction"), X.log_return(F.col("c"), F.col("close")).alias("target"))


@query(with_(BARS_SQL, RET_SQL + """ SELECT series, count(*) AS n, round(avg(abs(prediction - target)), 8) AS mae, round(avg(abs(abs(prediction) - abs(target))), 8) AS magnitude_mae,
round((avg(CASE WHEN target > 0 THEN CAST(prediction > 0 AS INTEGER) END) + avg(CASE WHEN target < 0 THEN CAST(prediction < 0 AS INTEGER) END)) / 2, 8) AS balanced_accuracy,
count(*) FILTER (WHERE prediction = 0) AS prediction_ties, count(*) FILTER (WHERE target = 0) AS target_ties, count(*) FILTER (WHERE target > 0) AS positive, count(*) FILTER (WHERE target < 0) AS negative FROM p GROUP BY 1"""))
def e4_return_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scores.return_metrics(returns(spark, sf), ["series"])


PROB_SQL = RET_SQL + ", q AS (SELECT *, -0.5 + 0.1 * tanh(prediction) AS q10, 0.05 * prediction AS q50, 0.5 + 0.1 * tanh(prediction) AS q90, 1 / (1 + exp(prediction)) AS p_up FROM p)"


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("prediction")
    return returns(spark, sf).withColumns({"q10": -0.5 + 0.1 * F.tanh(p), "q50": 0.05 * p, "q90": 0.5 + 0.1 * F.tanh(p), "p_up": 1 / (1 + F.exp(p))})


@query(with_(BARS_SQL, PROB_SQL + """ SELECT series, count(*) AS n, round(avg(greatest(0.1 * (target - q10), -0.9 * (target - q10))), 8) AS pinball_10, round(avg(greatest(0.5 * (target - q50), -0.5 * (target - q50))), 8) AS pinball_50,
round(avg(greatest(0.9 * (target - q90), -0.1 * (target - q90))), 8) AS pinball_90, round(avg(CAST(target BETWEEN q10 AND q90 AS INTEGER)), 8) AS coverage_80, round(avg(q90 - q10), 8) AS width_80,
round(avg((p_up - CAST(target > 0 AS INTEGER)) ** 2), 8) AS brier, round(avg(CASE WHEN target > 0 THEN -ln(p_up) ELSE -ln(1 - p_up) END), 8) AS log_score FROM q GROUP BY 1"""))
def e5_probability_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores.probability_scores(probabilities(spark, sf), ["series"])


@query(with_(BARS_SQL, PROB_SQL + " SELECT CAST(least(9, floor(p_up * 10)) AS INTEGER) AS bin, count(*) AS n, round(avg(p_up), 8) AS mean_p, round(avg(CAST(target > 0 AS INTEGER)), 8) AS frequency FROM q GROUP BY 1"))
def e5_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return scores.reliability(probabilities(spark, sf))


@query(with_(BARS_SQL, RET_SQL + " SELECT series, start_ns // 86400000000000 AS day, count(*) AS n, round(sum(abs(prediction - target)), 6) AS abs_loss, round(sum((prediction - target) ** 2), 6) AS sq_loss FROM p GROUP BY 1, 2"))
def e6_daily_losses(spark: SparkSession, sf: str) -> DataFrame:
    return scores.daily_losses(returns(spark, sf), ["series"])


@query(with_(BARS_SQL, RET_SQL + " SELECT series, round(quantile_cont(target, 0.1), 8) AS q10, round(quantile_cont(target, 0.5), 8) AS q50, round(quantile_cont(target, 0.9), 8) AS q90 FROM p GROUP BY 1"))
def e7_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return scores.quantiles(returns(spark, sf), ["series"], "target", {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query(with_(BARS_SQL, RET_SQL + f", m AS (SELECT series, avg(prediction) AS mean, stddev_pop(prediction) AS scale FROM p WHERE start_ns < {SPLITS[0][2]} GROUP BY 1) SELECT series, start_ns, round((prediction - mean) / CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) AS z FROM p JOIN m USING (series)"))
def e8_standardize(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf)
    m = scores.standardizer(r.where(F.col("start_ns") < SPLITS[0][2]), ["series"], "prediction")
    return r.join(m, "series").select("series", "start_ns", F.round((F.col("prediction") - F.col("mean")) / F.col("scale"), 6).alias("z"))


@query(f"WITH RECURSIVE {BARS_SQL}, g AS (SELECT series, min(start_ns) AS s FROM bars GROUP BY 1 UNION ALL SELECT g.series, (SELECT min(start_ns) FROM bars b WHERE b.series = g.series AND b.start_ns >= g.s + {24 * H}) FROM g WHERE g.s IS NOT NULL) SELECT series, CAST(count(s) AS INTEGER) AS blocks FROM g GROUP BY 1")
def e9_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return scores.blocks(bars(spark, sf), ["series"], 24 * H)


@query(with_(TICKS_SQL, " SELECT series, count(*) AS records, sum(octet_length(encode(CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR)))) AS payload_bytes, round(count(*) * 90.0 / 30, 4) AS records_90_days_per_day FROM ticks GROUP BY 1"))
def e12_volume_profile(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length(F.col("price").cast("decimal(18,2)").cast("string"))
    return ticks(spark, sf).groupBy("series").agg(F.count("*").alias("records"), F.sum(size).cast("bigint").alias("payload_bytes"), F.round(F.count("*") * 90.0 / 30, 4).alias("records_90_days_per_day"))


# ---- time series -------------------------------------------------------------------------------------------
@query(with_(BARS_SQL, LABEL_SQL + f" SELECT series, start_ns, lag_close, lag_reason, CASE WHEN label_reason IS NULL THEN c3 END AS label_close, CASE WHEN label_reason IS NULL THEN start_ns + {4 * H} END AS label_end_ns, label_reason FROM lab"))
def f1_f2_lag_label(spark: SparkSession, sf: str) -> DataFrame:
    return derive.lag_label(bars(spark, sf)).select("series", "start_ns", "lag_close", "lag_reason", "label_close", "label_end_ns", "label_reason")


@query(with_(BARS_SQL, f""", n AS (SELECT a.series, a.start_ns, b1.off AS o1, b2.off AS o2, b3.off AS o3, b1.finalized AS f1, b2.finalized AS f2 FROM bars a
LEFT JOIN bars b1 ON b1.series = a.series AND b1.start_ns = a.start_ns + {H} LEFT JOIN bars b2 ON b2.series = a.series AND b2.start_ns = a.start_ns + {2 * H} LEFT JOIN bars b3 ON b3.series = a.series AND b3.start_ns = a.start_ns + {3 * H}),
v AS (SELECT series, start_ns, o1, CASE WHEN f1 THEN o2 END AS o2, CASE WHEN f1 AND f2 THEN o3 END AS o3 FROM n)
SELECT series, start_ns, CAST((o1 IS NOT NULL)::INT + (o2 IS NOT NULL)::INT + (o3 IS NOT NULL)::INT AS INTEGER) AS n_visited, concat_ws(',', o1, o2, o3) AS visited FROM v"""))
def f3_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return derive.lineage(bars(spark, sf))


@query(with_(BARS_SQL, f""", r AS (SELECT *, ln("close") - ln(lag("close") OVER w) AS ret, start_ns - lag(start_ns, 6) OVER w AS back FROM bars WINDOW w AS (PARTITION BY series ORDER BY start_ns)),
f AS (SELECT series, start_ns, back, sum(ret) OVER w AS total, last_value(ret) OVER w AS last_ret FROM r WINDOW w AS (PARTITION BY series ORDER BY start_ns ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT series, start_ns, CASE WHEN back = {6 * H} THEN 6 END AS n_features, CASE WHEN back = {6 * H} THEN round(total, 6) END AS total, CASE WHEN back = {6 * H} THEN round(last_ret, 6) END AS last_return FROM f"""))
def f4_lagged_returns(spark: SparkSession, sf: str) -> DataFrame:
    f = derive.lagged_returns(bars(spark, sf), 6)
    return f.select("series", "start_ns", F.when(F.col("features").isNotNull(), F.size("features")).alias("n_features"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("features", F.lit(5)), 6).alias("last_return"))


GRID_SQL = f""", ends AS (SELECT series, min(start_ns) AS lo, max(start_ns) AS hi FROM bars GROUP BY 1), grid AS (SELECT series, unnest(range(lo, hi + 1, {H})) AS start_ns FROM ends),
dense AS (SELECT g.series, g.start_ns, b."close", b.finalized, CASE WHEN b.start_ns IS NULL THEN 'missing' WHEN NOT b.finalized THEN 'not-final' END AS bad FROM grid g LEFT JOIN bars b ON b.series = g.series AND b.start_ns = g.start_ns)"""


@query(with_(BARS_SQL, GRID_SQL + " SELECT series, start_ns, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY start_ns) > 24 THEN CAST(count(*) FILTER (WHERE bad = 'missing') OVER (PARTITION BY series ORDER BY start_ns ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS BIGINT) END AS n_missing FROM dense"))
def f5_gap_counts(spark: SparkSession, sf: str) -> DataFrame:
    return derive.gap_counts(bars(spark, sf), 24)


@query(with_(BARS_SQL, """, ends AS (SELECT series, min(start_ns - start_ns % 86400000000000) AS lo, max(start_ns - start_ns % 86400000000000) + 82800000000000 AS hi FROM bars GROUP BY 1), grid AS (SELECT series, unnest(range(lo, hi + 1, 3600000000000)) AS start_ns FROM ends),
d AS (SELECT g.series, g.start_ns, b."close", CASE WHEN b.start_ns IS NULL THEN 'missing' WHEN NOT b.finalized THEN 'not-final' END AS bad FROM grid g LEFT JOIN bars b ON b.series = g.series AND b.start_ns = g.start_ns)
SELECT series, start_ns - start_ns % 86400000000000 AS bucket_ns, CASE WHEN count(bad) = 0 THEN arg_max("close", start_ns) END AS "close", count(bad) AS n_bad, arg_min(bad, start_ns) FILTER (WHERE bad IS NOT NULL) AS reason FROM d GROUP BY 1, 2"""))
def f6_resample(spark: SparkSession, sf: str) -> DataFrame:
    return derive.resampled(bars(spark, sf))


@query(with_(BARS_SQL, f""", i AS (SELECT *, start_ns - row_number() OVER (PARTITION BY series ORDER BY start_ns) * {H} AS island FROM bars),
h AS (SELECT series, start_ns, least(row_number() OVER w, 512) AS n, sum("close") OVER (PARTITION BY series, island ORDER BY start_ns ROWS BETWEEN 511 PRECEDING AND CURRENT ROW) AS m FROM i WINDOW w AS (PARTITION BY series, island ORDER BY start_ns))
SELECT series, start_ns, CASE WHEN n >= 2 THEN CAST(n AS INTEGER) END AS history, round(m, 4) AS history_sum FROM h"""))
def f7_history(spark: SparkSession, sf: str) -> DataFrame:
    return derive.history_lengths(bars(spark, sf))


DAILY_SQL = ", days AS (SELECT series, CAST(start_ns // 86400000000000 AS BIGINT) AS day, sum(\"close\") / count(*) AS value FROM bars GROUP BY 1, 2)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy("series", F.expr(f"start_ns div {24 * H}").alias("day")).agg((F.sum("close") / F.count("*")).alias("value"))


@query(with_(BARS_SQL, DAILY_SQL + ' SELECT series, day, CASE WHEN count(*) OVER w = 7 THEN round(sum(value) OVER w, 6) END AS total FROM days WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)'))
def f8_window_sums(spark: SparkSession, sf: str) -> DataFrame:
    return derive.window_sums(daily(spark, sf), 7).withColumn("total", F.round("total", 6))


@query(with_(BARS_SQL, DAILY_SQL + """, b AS (SELECT series, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM days GROUP BY 1)
SELECT a.series, CAST(c.day - a.day AS INTEGER) AS lag, round(sum((a.value - m) * (c.value - m)) / any_value(n) / any_value(v), 6) AS r, abs(sum((a.value - m) * (c.value - m)) / any_value(n) / any_value(v)) > 2 / sqrt(any_value(n)) AS significant
FROM days a JOIN days c ON a.series = c.series AND c.day - a.day BETWEEN 1 AND 10 JOIN b ON b.series = a.series GROUP BY 1, 2"""))
def f9_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return derive.autocorrelation(daily(spark, sf), 10)


@query(with_(TICKS_SQL, """, c AS (SELECT *, CASE WHEN lag(day) OVER w IS DISTINCT FROM day OR lag(series) OVER w IS DISTINCT FROM series THEN 1 ELSE 0 END AS ch FROM (SELECT *, ns // 86400000000000 AS day FROM ticks) WINDOW w AS (PARTITION BY producer ORDER BY off)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY producer ORDER BY off) AS island FROM c), p AS (SELECT *, (row_number() OVER (PARTITION BY producer, island ORDER BY off) - 1) // 2 AS part FROM i)
SELECT producer, off AS "offset", CAST(dense_rank() OVER (PARTITION BY producer ORDER BY island, part) AS INTEGER) AS segment FROM p"""))
def f10_segments(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumn("day", F.expr(f"ns div {24 * H}"))
    return derive.segments(t, ["day", "series"], 2).select("producer", "offset", "segment")


@query(with_(BARS_SQL, " SELECT series, start_ns FROM (SELECT *, row_number() OVER (PARTITION BY series, finalized ORDER BY start_ns) AS rn FROM bars) WHERE rn <= 20"))
def f12_first_cases(spark: SparkSession, sf: str) -> DataFrame:
    return derive.first_cases(bars(spark, sf), ["series", "finalized"], F.col("start_ns"), 20).select("series", "start_ns")


# ---- order and sets ----------------------------------------------------------------------------------------
@query(with_(BARS_SQL, ' SELECT series, start_ns, "close" FROM bars ORDER BY start_ns, series LIMIT 100 OFFSET 50'))
def a13_page(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("series", "start_ns", "close").orderBy("start_ns", "series").offset(50).limit(100)


@query(with_(BARS_SQL, """, a AS (SELECT series, start_ns, CASE WHEN start_ns % 7 = 0 THEN n ELSE n + 1 END AS n FROM bars), b AS (SELECT series, start_ns, n FROM bars WHERE n % 5 <> 0)
SELECT *, 'left' AS side FROM (SELECT series, start_ns, n FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT series, start_ns, n FROM a)"""))
def g4_differences(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("series", "start_ns", "n")
    return ledger.differences(b.withColumn("n", F.when(F.col("start_ns") % 7 == 0, F.col("n")).otherwise(F.col("n") + 1)), b.where("n % 5 <> 0"))


# ---- coverage ----------------------------------------------------------------------------------------------
GAP_SQL = f", gaps AS (SELECT series, CASE WHEN finalized THEN start_ns + {H} ELSE start_ns END AS gap_start, lead(start_ns) OVER (PARTITION BY series ORDER BY start_ns) AS gap_end FROM bars)"


@query(with_(BARS_SQL, GAP_SQL + " SELECT * FROM gaps WHERE gap_end > gap_start"))
def h1_candle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.candle_gaps(bars(spark, sf))


SEQ_SQL = """ seq AS (SELECT conv_id % 50 AS stream, conv_id AS session, turn AS seq, conv_id * 1000 + turn AS off FROM conversations WHERE (conv_id * 31 + turn * 17) % 5 <> 0)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("(conv_id * 31 + turn * 17) % 5 <> 0")
    return c.select((F.col("conv_id") % 50).alias("stream"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (F.col("conv_id") * 1000 + F.col("turn")).alias("offset"))


@query("WITH" + SEQ_SQL + """, h AS (SELECT *, max(seq) OVER (PARTITION BY stream, session ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM seq)
SELECT stream, session, high + 1 AS first_missing, seq - 1 AS last_missing, off AS "offset" FROM h WHERE seq > high + 1""")
def h2_sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.sequence_gaps(sequences(spark, sf))


@query("WITH" + SEQ_SQL + """, e AS (SELECT *, seq = 0 AS snap, sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY off) AS epoch FROM seq),
s AS (SELECT *, coalesce(snap OR seq = lag(seq) OVER (PARTITION BY stream, epoch ORDER BY off) + 1, false) AS ok FROM e),
v AS (SELECT *, epoch > 0 AND min(CAST(ok AS INTEGER)) OVER (PARTITION BY stream, epoch ORDER BY off) = 1 AS valid FROM s)
SELECT stream, off AS "offset", valid, epoch > 0 AND NOT valid AND coalesce(lag(valid) OVER (PARTITION BY stream, epoch ORDER BY off), false) AS loss FROM v""")
def h3_book_validity(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences(spark, sf).withColumn("is_snapshot", F.col("seq") == 0)
    return coverage.book_validity(rows).select("stream", "offset", "valid", "loss")


@query(with_(BARS_SQL, f""", c AS ({CLAIMS}), s AS ({SPANS}),
o AS (SELECT s.*, c.claim_start, c.claim_end, c.status, claim_start > coalesce(max(claim_end) OVER (PARTITION BY s.series, span_start, span_end ORDER BY claim_start, claim_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), span_start) AS hole FROM s JOIN c ON s.series = c.series AND span_start < claim_end AND claim_start < span_end),
a AS (SELECT series, span_start, span_end, bool_or(hole) AS hole, max(claim_end) AS reach, bool_or(status = 'unrecoverable') AS u, bool_or(status = 'pending') AS p FROM o GROUP BY 1, 2, 3)
SELECT s.series, s.span_start, s.span_end, CASE WHEN u THEN 'unrecoverable' WHEN p THEN 'pending' WHEN NOT hole AND reach >= s.span_end THEN 'complete' ELSE 'unknown' END AS status FROM s LEFT JOIN a USING (series, span_start, span_end)"""))
def h5_coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_status(*claims_of(bars(spark, sf)))


@query(with_(BARS_SQL, GAP_SQL + f""", w AS (SELECT series, gap_start, gap_end, unnest(range(gap_start, gap_end, {H})) AS start_ns FROM gaps WHERE gap_end > gap_start),
r AS (SELECT w.series, gap_start, gap_end, count(*) AS expected, count(b.start_ns) AS proven FROM w LEFT JOIN bars b ON b.series = w.series AND b.start_ns = w.start_ns GROUP BY 1, 2, 3)
SELECT *, CASE WHEN expected = proven THEN 'complete' ELSE 'pending' END AS state FROM r"""))
def h6_repair(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    return coverage.repair(coverage.candle_gaps(b), b, False)


@query(with_(BARS_SQL, f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN p."close" < 0 THEN 'malformed' WHEN p.start_ns < {T0 + 48 * H} OR p.start_ns >= {T0 + 600 * H} THEN 'outside' WHEN k.series IS NULL THEN 'admit' WHEN k."close" = p."close" THEN 'duplicate' ELSE 'conflict' END AS action
FROM (SELECT series, start_ns, CASE WHEN n % 13 = 0 THEN -1 WHEN n % 5 = 0 THEN "close" + 1 ELSE "close" END AS "close" FROM bars) p LEFT JOIN (SELECT * FROM bars WHERE finalized) k ON k.series = p.series AND k.start_ns = p.start_ns) GROUP BY 1""").replace("finalized FROM ticks GROUP BY 1, 2)SELECT", "finalized FROM ticks GROUP BY 1, 2) SELECT"))
def h7_admission(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    page = b.select("series", "start_ns", F.when(F.col("n") % 13 == 0, -1.0).when(F.col("n") % 5 == 0, F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    return coverage.admission(page, b.where("finalized"), T0 + 48 * H, T0 + 600 * H).groupBy("action").agg(F.count("*").alias("n"))


@query(with_(BARS_SQL, GAP_SQL + f" SELECT series, least(f, coalesce(u, f)) AS checkpoint_ns FROM (SELECT series, max(start_ns + {H}) AS f FROM bars WHERE finalized GROUP BY 1) LEFT JOIN (SELECT series, min(gap_start) AS u FROM gaps WHERE gap_end > gap_start GROUP BY 1) USING (series)"))
def h8_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.checkpoint(bars(spark, sf))


@query(with_(TICKS_SQL, """, s AS (SELECT series AS stream, ns // 259200000000000 AS session, min(ns) AS a, max(ns) AS b FROM ticks GROUP BY 1, 2)
SELECT stream, session, b AS gap_start, lead(a) OVER (PARTITION BY stream ORDER BY a, session) AS gap_end, 'unknown' AS status FROM s"""))
def h9_restarts(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.restarts(ticks(spark, sf).select(F.col("series").alias("stream"), F.expr(f"ns div {72 * H}").alias("session"), "ns"))


@query(with_(BARS_SQL, " SELECT series, start_ns, open, high, low, \"close\", n, off AS \"offset\", finalized FROM bars"))
def h12_candles(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf)


@query(with_(TICKS_SQL, f" SELECT series, max(ns) AS last_ns, count(*) AS received, {T0 + 720 * H} - max(ns) AS age_ns, {T0 + 720 * H} - max(ns) > 600000000000 AS stale FROM ticks GROUP BY 1"))
def h13_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.freshness(ticks(spark, sf), T0 + 720 * H, 600_000_000_000)


# ---- targets and comparison --------------------------------------------------------------------------------
ORIGIN_SQL = GRID_SQL + f""", o AS (SELECT series, start_ns + {H} AS origin_ns, "close", CASE WHEN count(*) OVER w < 12 THEN 'missing-history-boundary' ELSE arg_min(bad, start_ns) FILTER (WHERE bad IS NOT NULL) OVER w END AS reason FROM dense WINDOW w AS (PARTITION BY series ORDER BY start_ns ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query(with_(BARS_SQL, ORIGIN_SQL + ' SELECT series, origin_ns, "close", reason FROM o'))
def j1_origins(spark: SparkSession, sf: str) -> DataFrame:
    return scores.origins(bars(spark, sf), 12)


@query(with_(BARS_SQL, ORIGIN_SQL + f""", e AS (SELECT b.series, b.start_ns, b."close" AS end_close FROM bars b WHERE (SELECT count(*) FROM bars x WHERE x.series = b.series AND x.finalized AND x.start_ns BETWEEN b.start_ns - {3 * H} AND b.start_ns) = 4)
SELECT o.series, origin_ns, round(ln(end_close) - ln("close"), 8) AS target, CASE WHEN end_close IS NULL THEN 'outcome-missing' END AS reason FROM o LEFT JOIN e ON e.series = o.series AND e.start_ns = origin_ns + {3 * H} WHERE o.reason IS NULL"""))
def j2_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    return scores.outcomes(b, scores.origins(b, 12), 4)


@query(with_(BARS_SQL, RET_SQL + """, m AS (SELECT series, count(*) AS n, avg(target) AS my, stddev_pop(prediction) AS sx, covar_pop(prediction, target) AS cxy, var_pop(prediction) AS vx FROM p GROUP BY 1)
SELECT series, n, round(n * cxy / sx / (n * vx / sx / sx + 1), 8) AS weight, round(my, 8) AS intercept FROM m"""))
def j12_ridge_one(spark: SparkSession, sf: str) -> DataFrame:
    return scores.ridge_one(returns(spark, sf).select("series", F.col("prediction").alias("x"), F.col("target").alias("y")), ["series"])


@query(with_(BARS_SQL, RET_SQL + " SELECT series, round(sqrt(avg(target * target)) * sqrt(24), 8) AS scale, round((count(*) FILTER (WHERE target > 0) + 0.5) / (count(*) FILTER (WHERE target <> 0) + 1), 8) AS p_up FROM p GROUP BY 1"))
def j13_volatility(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("target")
    return returns(spark, sf).groupBy("series").agg(F.round(F.sqrt(F.avg(t * t)) * F.sqrt(F.lit(24.0)), 8).alias("scale"), F.round((F.count_if(t > 0) + 0.5) / (F.count_if(t != 0) + 1), 8).alias("p_up"))


@query()
def j15_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Paired moving-block bootstrap of daily losses; the draws come from the seed, so the result is fixed."""
    d = scores.daily_losses(returns(spark, sf), ["series"])
    first, days = d.agg(F.min("day"), F.coalesce(F.max("day") - F.min("day") + 1, F.lit(0))).first()
    # all series over all days, as the draws are shared; a day without cases adds nothing
    grid = d.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(days - 1, 0)).cast("bigint"))).alias("day"))
    index = grid.join(d.select("series", (F.col("day") - F.lit(first)).alias("day"), "abs_loss"), ["series", "day"], "left").select("series", "day", F.coalesce("abs_loss", F.lit(0.0)).alias("loss"))
    return scores.bootstrap(index, scores.draws(spark, days, 7), 7)


@query(with_(BARS_SQL, RET_SQL + """, t AS (SELECT series AS name, round(abs(avg(target)) * 100, 6) AS p FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM t)
SELECT name, p, CAST(rank AS INTEGER) AS rank, bool_and(p <= 0.05 / (m - rank + 1)) OVER (ORDER BY rank) AS rejected FROM r"""))
def j17_holm(spark: SparkSession, sf: str) -> DataFrame:
    tests = returns(spark, sf).groupBy(F.col("series").alias("name")).agg(F.round(F.abs(F.avg("target")) * 100, 6).alias("p"))
    return scores.holm(tests)


@query(with_(BARS_SQL, f""", h AS (SELECT unnest([1, 24, 168]) AS horizon), q AS (SELECT h.horizon, a.finalized AS f1, b.finalized AS f2, b.series IS NULL AS gone, CAST(round((b."close" - a."close") * 100) AS BIGINT) AS c FROM bars a CROSS JOIN h LEFT JOIN bars b ON b.series = a.series AND b.start_ns = a.start_ns + h.horizon * {H})
SELECT CAST(horizon AS INTEGER) AS horizon, count(*) FILTER (WHERE NOT gone AND f1 AND f2) AS eligible, count(*) FILTER (WHERE gone) AS missing, count(*) FILTER (WHERE NOT gone AND NOT (f1 AND f2)) AS invalid, CAST(sum(c) FILTER (WHERE NOT gone AND f1 AND f2) AS BIGINT) AS cents FROM q GROUP BY 1"""))
def j20_horizon_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scores.horizon_summary(scores.horizon_pairs(bars(spark, sf), [1, 24, 168]))


# ---- ledger and lineage ------------------------------------------------------------------------------------
SLOT_SQL = f""", s AS (SELECT DISTINCT series FROM ticks), g AS (SELECT series, unnest(range({T0}, {T0 + 720 * H}, {H})) AS origin_ns FROM s),
slots AS (SELECT series, origin_ns, h AS horizon FROM g CROSS JOIN (SELECT unnest([1, 24, 168]) AS h) WHERE h < 24 OR origin_ns % {24 * H} = 0)"""


def due(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.slots(ticks(spark, sf).select("series").distinct(), T0, T0 + 720 * H, [1, 24, 168])


@query(with_(BARS_SQL, SLOT_SQL + " SELECT series, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, min(origin_ns) AS first_ns FROM slots GROUP BY 1, 2"))
def k1_due_slots(spark: SparkSession, sf: str) -> DataFrame:
    return due(spark, sf).groupBy("series", "horizon").agg(F.count("*").alias("n"), F.min("origin_ns").alias("first_ns"))


@query(with_(OBS_SQL, """, w AS (SELECT series || ':' || start_ns AS slot, off, revision, first_value(revision) OVER (PARTITION BY series, start_ns ORDER BY off) AS f, row_number() OVER (PARTITION BY series, start_ns ORDER BY off) AS rn FROM obs)
SELECT slot, off AS sequence, CASE WHEN rn = 1 THEN 'published' WHEN f = revision THEN 'repeat' ELSE 'conflict' END AS outcome FROM w"""))
def k2_publish(spark: SparkSession, sf: str) -> DataFrame:
    e = observations(spark, sf).select(F.concat_ws(":", "series", F.col("start_ns").cast("string")).alias("slot"), F.col("offset").alias("sequence"), F.col("revision").alias("content"))
    return ledger.published(e).select("slot", "sequence", "outcome")


@query(with_(BARS_SQL, SLOT_SQL + f" SELECT series, CAST(horizon AS INTEGER) AS horizon, CASE WHEN origin_ns + {2 * H} < {T0 + 700 * H} THEN 'missed' ELSE 'missing' END AS state, count(*) AS n FROM slots WHERE (series, origin_ns) NOT IN (SELECT series, start_ns FROM bars) GROUP BY 1, 2, 3"))
def k4_missed_slots(spark: SparkSession, sf: str) -> DataFrame:
    done = bars(spark, sf).select("series", F.col("start_ns").alias("origin_ns"))
    return ledger.missed(due(spark, sf), done, ["series", "origin_ns"], T0 + 700 * H, 2 * H).groupBy("series", "horizon", "state").agg(F.count("*").alias("n"))


@query(with_(OBS_SQL, """, o AS (SELECT series || ':' || start_ns AS slot, off AS as_of, price AS version, lag(price) OVER (PARTITION BY series, start_ns ORDER BY off) AS supersedes FROM obs), v AS (SELECT * FROM o WHERE supersedes IS NULL OR version <> supersedes)
SELECT slot, as_of, version, supersedes, CAST(row_number() OVER (PARTITION BY slot ORDER BY as_of) AS INTEGER) AS vintage FROM v"""))
def k6_vintages(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf).select(F.concat_ws(":", "series", F.col("start_ns").cast("string")).alias("slot"), F.col("offset").alias("as_of"), F.col("price").cast("bigint").alias("version"))
    return ledger.vintages(o)


@query(with_(OBS_SQL, """, v AS (SELECT series || ':' || start_ns AS slot, off, price FROM obs WHERE off <= 5000)
SELECT slot, min(off) AS first_as_of, CAST(arg_min(price, off) AS BIGINT) AS first_price, max(off) AS latest_as_of, CAST(arg_max(price, off) AS BIGINT) AS latest_price FROM v GROUP BY 1"""))
def k8_score_views(spark: SparkSession, sf: str) -> DataFrame:
    s = observations(spark, sf).select(F.concat_ws(":", "series", F.col("start_ns").cast("string")).alias("slot"), F.col("offset").alias("as_of"), F.col("price").cast("bigint").alias("price"))
    one, two = ledger.score_view(s, 5000, True), ledger.score_view(s, 5000, False)
    return one.select("slot", F.col("as_of").alias("first_as_of"), F.col("price").alias("first_price")).join(two.select("slot", F.col("as_of").alias("latest_as_of"), F.col("price").alias("latest_price")), "slot")


@query(with_(BARS_SQL, RET_SQL + """, l AS (SELECT series || start_ns AS truth, CAST(start_ns // 3600000000000 % 3 AS BIGINT) AS horizon, abs(prediction - target) AS e FROM p WHERE prediction > 0), r AS (SELECT series || start_ns AS truth, abs(target) AS e FROM p)
SELECT horizon, count(*) AS n, round(avg(l.e) - avg(r.e), 8) AS mae_difference FROM l JOIN r USING (truth) GROUP BY ROLLUP (horizon) HAVING count(*) > 0"""))
def k10_compare_risen(spark: SparkSession, sf: str) -> DataFrame:
    """K10, C9 with a left stream of risen bars only."""
    p = returns(spark, sf).withColumn("truth", F.concat("series", F.col("start_ns").cast("string")))
    left = p.where("prediction > 0").select("truth", (F.expr(f"start_ns div {H}") % 3).alias("horizon"), F.abs(F.col("prediction") - F.col("target")).alias("abs_error"))
    return ledger.compared(left, p.select("truth", F.abs("target").alias("abs_error")))


DIGEST_SQL = """, d AS (SELECT producer % 10 AS producer, off, sha256(series || '|' || off || '|' || ns) AS h FROM ticks), dig AS (SELECT producer, off // 1000 AS segment, count(*) AS n, sha256(string_agg(h, '' ORDER BY off)) AS digest FROM d GROUP BY 1, 2)"""


def digests(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).select((F.col("producer") % 10).alias("producer"), F.expr("offset div 1000").alias("segment"), "offset", "series", "ns")
    return ledger.digest(t, ["producer", "segment"], ["offset"], [F.col("series"), F.col("offset").cast("string"), F.col("ns").cast("string")])


@query(with_(TICKS_SQL, DIGEST_SQL + " SELECT producer, segment, n, digest FROM dig"))
def l2_ordered_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digests(spark, sf)


@query(f"""WITH RECURSIVE {TICKS_SQL}{DIGEST_SQL}, m AS (SELECT producer, CAST(row_number() OVER (PARTITION BY producer ORDER BY segment) AS INTEGER) AS sequence, digest FROM dig),
c AS (SELECT producer, sequence, repeat('0', 64) AS previous, sha256(sequence || '|' || digest || '|' || repeat('0', 64)) AS own FROM m WHERE sequence = 1
UNION ALL SELECT m.producer, m.sequence, c.own, sha256(m.sequence || '|' || m.digest || '|' || c.own) FROM m JOIN c ON m.producer = c.producer AND m.sequence = c.sequence + 1) SELECT * FROM c""")
def l3_manifest_chain(spark: SparkSession, sf: str) -> DataFrame:
    d = digests(spark, sf)
    return ledger.chained(d.select("producer", F.row_number().over(W.partitionBy("producer").orderBy("segment")).alias("sequence"), "digest"))


@query(with_(TICKS_SQL, DIGEST_SQL + " SELECT producer, CAST(2 AS INTEGER) AS sequence FROM dig GROUP BY 1 HAVING count(*) >= 2"))
def l4_chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """The second manifest of each chain is tampered with; the check must name exactly these."""
    chain = l3_manifest_chain(spark, sf)
    return ledger.chain_breaks(chain.withColumn("previous", F.when(F.col("sequence") == 2, "tampered").otherwise(F.col("previous"))))


# the rest registers itself
from tidemark.plans import contracts, forecasts, grids, live, market, replay, sources, streams  # noqa: E402, F401
