"""Queries of the forecast ledger, audits, clocks and batches (K3, K5, K9 to K12, L4, L5, L7 to L10, H4, F11, F13). The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.catalog import RET_SQL, T0, H, query, returns, with_
from tidemark.functions import expressions as X
from tidemark.operators import archive, coverage, forecasts
from tidemark.sources.views import BARS_SQL, TICKS_SQL, bars, table, ticks

DAY = X.DAY_NS
FINAL, AS_OF, DELAY = T0 + 28 * DAY, T0 + 25 * DAY, 60_000_000_000
MINUTE = 60_000_000_000

#: Two streams of forecasts made of the returns; the hour of the day says what befalls a slot: 5 no signal, 6 late, 7
#: unknown clock, 8 no input, 9 two inputs, 10 another close, 11 late certificate, 12 never published, 13 not observed,
#: 14 two certificates, 15 marked before its publication; at hour 3 the score is revised a day later.
PUB_SQL = RET_SQL + f""",
base AS (SELECT *, (start_ns // {H}) % 24 AS h, start_ns + {H} AS origin_ns, CASE WHEN (start_ns // {H}) % 4 = 0 THEN 24 ELSE 1 END AS horizon,
  CASE WHEN series IN ('click', 'view') THEN 'forward-shadow' WHEN series = 'error' THEN 'synthetic-fixture' ELSE 'retrospective' END AS declared,
  CASE (start_ns // {H}) % 24 WHEN 6 THEN 'late' WHEN 7 THEN 'unknown' ELSE 'on-time' END AS timeliness FROM p),
pub AS (SELECT st.stream, st.stream || ':' || series || ':' || origin_ns AS slot, series AS instrument, origin_ns, CAST(horizon AS BIGINT) AS horizon, origin_ns + horizon * {H} AS endpoint_ns, declared, timeliness, h,
  CASE WHEN h <> 5 THEN prediction * st.sign END AS point, CASE WHEN h = 5 THEN 'no-signal' END AS why, CASE WHEN h <> 13 THEN origin_ns + {MINUTE // 2} END AS committed_ns, target,
  CASE WHEN declared <> 'forward-shadow' THEN declared WHEN h = 6 THEN 'late-forward' WHEN h IN (7, 8, 9, 10, 11, 14) THEN 'forward-unclassified' ELSE 'genuine-forward' END AS evidence_class
  FROM base CROSS JOIN (VALUES ('momentum', 1), ('reversal', -1)) st(stream, sign)),
pre AS (SELECT *, CASE WHEN declared = 'forward-shadow' AND endpoint_ns >= {FINAL} THEN 'sealed' WHEN declared = 'forward-shadow' AND evidence_class <> 'genuine-forward' THEN 'excluded'
  WHEN declared = 'synthetic-fixture' AND timeliness <> 'on-time' THEN 'excluded' WHEN point IS NULL THEN 'abstained' WHEN {AS_OF} < endpoint_ns + {DELAY} THEN 'pending' END AS pre_state,
  CASE WHEN declared = 'forward-shadow' AND endpoint_ns >= {FINAL} THEN 'final-outcome-access-denied' WHEN declared = 'forward-shadow' AND evidence_class <> 'genuine-forward' THEN evidence_class
  WHEN declared = 'synthetic-fixture' AND timeliness <> 'on-time' THEN 'publication-' || timeliness WHEN point IS NULL THEN why WHEN {AS_OF} < endpoint_ns + {DELAY} THEN 'not-mature' END AS pre_reason FROM pub WHERE h <> 12)"""


def publications(spark: SparkSession, sf: str) -> DataFrame:
    """The publications with their evidence class (K3), and what the queries below need of their origin."""
    h = F.expr(f"start_ns div {H} % 24")
    r = returns(spark, sf).select(
        "series", (F.col("start_ns") + H).alias("origin_ns"), h.alias("h"), F.when(h % 4 == 0, 24).otherwise(1).cast("bigint").alias("horizon"), "prediction", "target",
        F.when(F.col("series").isin("click", "view"), "forward-shadow").when(F.col("series") == "error", "synthetic-fixture").otherwise("retrospective").alias("declared"))
    r = r.withColumn("timeliness", F.when(F.col("h") == 6, "late").when(F.col("h") == 7, "unknown").otherwise("on-time"))
    r = r.withColumn("input_id", F.concat_ws(":", "series", F.col("origin_ns").cast("string"))).withColumn("close", F.lit("1.5")).withColumn("reference", F.col("input_id")).withColumn("instrument", F.col("series"))
    copies = F.when(F.col("h") == 8, F.array().cast("array<int>")).when(F.col("h") == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    inputs = r.select("input_id", "origin_ns", "instrument", "reference", F.when(F.col("h") == 10, "1.6").otherwise(F.col("close")).alias("close"), F.explode(copies).alias("_")).drop("_")
    proofs = F.when(F.col("h") == 14, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    certificates = r.select("input_id", F.col("origin_ns").alias("latest_available_ns"), F.when(F.col("h") == 11, "late").otherwise("on-time").alias("timeliness"), F.explode(proofs).alias("_")).drop("_")
    streams = F.explode(F.array(F.struct(F.lit("momentum").alias("stream"), F.lit(1).alias("sign")), F.struct(F.lit("reversal").alias("stream"), F.lit(-1).alias("sign"))))
    rows = r.withColumn("s", streams).withColumn("stream", F.col("s.stream")).withColumn("latest_available_ns", F.col("origin_ns"))
    rows = rows.withColumn("slot", F.concat_ws(":", "stream", "series", F.col("origin_ns").cast("string"))).withColumn("endpoint_ns", F.col("origin_ns") + F.col("horizon") * H)
    rows = rows.withColumn("point", F.when(F.col("h") != 5, F.col("prediction") * F.col("s.sign"))).withColumn("why", F.when(F.col("h") == 5, "no-signal")).withColumn("committed_ns", F.when(F.col("h") != 13, F.col("origin_ns") + MINUTE // 2))
    out = forecasts.receipts(rows, inputs, certificates)
    return out.select("stream", "slot", "instrument", "origin_ns", "horizon", "endpoint_ns", "declared", "timeliness", "h", "point", "why", "committed_ns", "target", "evidence_class")


@query(with_(BARS_SQL, PUB_SQL + " SELECT stream, declared, timeliness, evidence_class, count(*) AS n FROM pub GROUP BY 1, 2, 3, 4"))
def k3_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return publications(spark, sf).groupBy("stream", "declared", "timeliness", "evidence_class").agg(F.count("*").alias("n"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return publications(spark, sf).where("h <> 12").withColumn("pre", forecasts.pre_score_state(FINAL, AS_OF, DELAY))


@query(with_(BARS_SQL, PUB_SQL + " SELECT slot, coalesce(pre_state, 'due') AS state, pre_reason AS reason FROM pre"))
def k5_pre_score_state(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("slot", F.coalesce("pre.state", F.lit("due")).alias("state"), F.col("pre.reason").alias("reason"))


COHORT_SQL = PUB_SQL + f""",
sc AS (SELECT slot, instrument || ':' || origin_ns || ':' || horizon AS truth, endpoint_ns + {DELAY} AS as_of_ns, round(abs(point - target), 8) AS e FROM pre WHERE pre_state IS NULL
  UNION ALL SELECT slot, instrument || ':' || origin_ns || ':' || horizon, endpoint_ns + {DAY}, round(abs(point - target), 8) + 0.5 FROM pre WHERE pre_state IS NULL AND h = 3),
seen AS (SELECT slot, arg_max(truth, as_of_ns) AS truth, arg_max(e, as_of_ns) AS e, arg_min(e, as_of_ns) AS first_e FROM sc WHERE as_of_ns <= {AS_OF} GROUP BY 1),
mark AS (SELECT slot, CASE WHEN h = 12 THEN 'missed' ELSE 'missing' END AS state, CASE WHEN h = 12 THEN 'no-run' ELSE 'queued' END AS reason, origin_ns + {2 * MINUTE} AS as_of_ns FROM pub WHERE h IN (12, 15) AND origin_ns + {2 * MINUTE} <= {AS_OF}),
co AS (SELECT coalesce(m.slot, q.slot) AS slot, q.*, s.truth, s.e, s.first_e, m.state AS m_state, m.reason AS m_reason, m.as_of_ns AS m_ns
  FROM mark m FULL JOIN (SELECT * FROM pub WHERE h <> 12 AND committed_ns <= {AS_OF}) q ON m.slot = q.slot LEFT JOIN seen s ON s.slot = q.slot),
cohort AS (SELECT *, CASE WHEN declared = 'forward-shadow' AND evidence_class <> 'genuine-forward' THEN CASE WHEN evidence_class = 'late-forward' THEN 'late' ELSE 'unclassifiable' END
  WHEN declared IN ('forward-shadow', 'synthetic-fixture') AND timeliness <> 'on-time' THEN CASE WHEN timeliness = 'late' THEN 'late' ELSE 'unclassifiable' END
  WHEN e IS NOT NULL THEN 'scored' WHEN m_state IS NOT NULL THEN m_state WHEN point IS NULL THEN 'abstained' ELSE 'pending' END AS state,
  CASE WHEN declared = 'forward-shadow' AND evidence_class <> 'genuine-forward' THEN evidence_class WHEN declared IN ('forward-shadow', 'synthetic-fixture') AND timeliness <> 'on-time' THEN timeliness
  WHEN e IS NOT NULL OR m_state IS NULL THEN why ELSE m_reason END AS reason FROM co)"""


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    pre = judged(spark, sf)
    due = pre.where("pre is null")
    truth = F.concat_ws(":", "instrument", F.col("origin_ns").cast("string"), F.col("horizon").cast("string"))
    error = F.round(F.abs(F.col("point") - F.col("target")), 8)
    vintages = F.array(F.struct((F.col("endpoint_ns") + DELAY).alias("as_of_ns"), error.alias("abs_error")), F.when(F.col("h") == 3, F.struct((F.col("endpoint_ns") + DAY).alias("as_of_ns"), (error + 0.5).alias("abs_error"))))
    scores = due.select("slot", truth.alias("truth"), F.explode(F.filter(vintages, lambda x: x.isNotNull())).alias("v")).select("slot", "truth", "v.*")
    marked = publications(spark, sf).where("h in (12, 15)")
    marks = marked.select("slot", F.when(F.col("h") == 12, "missed").otherwise("missing").alias("state"), F.when(F.col("h") == 12, "no-run").otherwise("queued").alias("reason"), (F.col("origin_ns") + 2 * MINUTE).alias("as_of_ns"))
    return forecasts.cohort(marks, pre.drop("pre", "h", "target"), scores, AS_OF)


@query(with_(BARS_SQL, COHORT_SQL + " SELECT slot, state, reason, greatest(committed_ns, m_ns) AS seen_ns FROM cohort"))
def k9_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohort(spark, sf).select("slot", "state", "reason", "seen_ns")


@query(with_(BARS_SQL, COHORT_SQL + """, s AS (SELECT stream, horizon, truth, e FROM cohort WHERE state = 'scored')
SELECT l.horizon, count(*) AS paired, round(avg(l.e) - avg(r.e), 8) AS mae_difference FROM s l JOIN s r ON l.truth = r.truth WHERE l.stream = 'momentum' AND r.stream = 'reversal' GROUP BY ROLLUP (l.horizon)"""))
def k10_stream_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts.compared(cohort(spark, sf), "momentum", "reversal")


@query(with_(BARS_SQL, COHORT_SQL + " SELECT stream, horizon, instrument, state, count(*) AS n FROM cohort GROUP BY GROUPING SETS ((stream, state), (stream, horizon, instrument, state))"))
def e11_cohort_states(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts.cohort_counts(cohort(spark, sf))


@query(with_(BARS_SQL, COHORT_SQL + f""" SELECT slot, stream, instrument, horizon, coalesce(evidence_class, declared) AS evidence_class, timeliness, origin_ns + {DELAY} AS deadline_ns, state, reason, endpoint_ns + {DELAY} AS expected_maturity_ns,
first_e AS first_error, e AS revised_error FROM cohort ORDER BY slot LIMIT 200 OFFSET 100"""))
def k12_inspection(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts.inspected(cohort(spark, sf), DELAY, 100, 200)


@query(with_(BARS_SQL, f""" SELECT series AS instrument, start_ns AS origin_ns, series || ':' || start_ns AS input_id, CASE WHEN (start_ns // {H}) % 2 = 0 THEN 'o:' || series || ':' || start_ns ELSE '' END AS observation_id FROM bars WHERE (start_ns // {H}) % 24 NOT IN (4, 16, 18, 21)"""))
def k11_cached_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Even hours have a later observation; hours 4 and 21 lack a certificate, 16 has two, the clock of 18 is not qualified."""
    h = F.expr(f"start_ns div {H} % 24")
    b = bars(spark, sf).select(F.col("series").alias("instrument"), F.col("start_ns").alias("origin_ns"), h.alias("h"), F.concat_ws(":", "series", F.col("start_ns").cast("string")).alias("input_id"))
    inputs = b.select("instrument", "origin_ns", "input_id", (F.col("origin_ns") * 2).alias("sequence"))
    even = b.where("h % 2 = 0").withColumn("observation_id", F.concat(F.lit("o:"), "input_id"))
    observations = even.select("input_id", "observation_id", (F.col("origin_ns") * 2 + 1).alias("sequence"))
    named = b.join(even.select("input_id", "observation_id"), "input_id", "left").where("h not in (4, 21)").withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 16, 2).otherwise(1))))
    stale = b.where("h % 2 = 0").select("input_id", F.lit(None).cast("string").alias("observation_id"), F.lit(True).alias("clock_qualified"))
    certificates = named.select("input_id", "observation_id", (F.col("h") != 18).alias("clock_qualified")).union(stale)
    return forecasts.cached_origins(inputs, observations, certificates).select("instrument", "origin_ns", "input_id", "observation_id")


# ---- lineage audits ----------------------------------------------------------------------------------------
LOG_SQL = """, e AS (SELECT series AS log, row_number() OVER (PARTITION BY series ORDER BY off) AS sequence, off, price FROM ticks)"""


@query(with_(TICKS_SQL, LOG_SQL + """, f AS (SELECT log, sequence, price, lag(price) OVER w AS before, lag(sequence) OVER w AS s FROM e WHERE price >= 2 WINDOW w AS (PARTITION BY log ORDER BY sequence)),
g AS (SELECT *, CASE WHEN sequence <> coalesce(s + 1, 1) THEN 'sequence' WHEN price > 600 THEN 'previous' WHEN price < 4 THEN 'body' END AS fault FROM f)
SELECT log, fault, count(*) AS n FROM g WHERE fault IS NOT NULL GROUP BY 1, 2"""))
def l7_event_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of ticks: cheap ones are missing, those below 4 have another body, the dear ones another previous hash."""
    own = W.partitionBy("log").orderBy("sequence")
    e = ticks(spark, sf).select(F.col("series").alias("log"), F.row_number().over(W.partitionBy("series").orderBy("offset")).alias("sequence"), "offset", "price")
    body = F.concat_ws("|", "log", F.col("sequence").cast("string"), F.col("offset").cast("string"))
    e = e.withColumn("body", body).withColumn("sha", F.sha2("body", 256))
    e = e.withColumn("previous", F.when(F.col("price") > 600, "tampered").otherwise(F.coalesce(F.lag("sha").over(own), F.lit("0" * 64)))).withColumn("body", F.when(F.col("price") < 4, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    rows = forecasts.chain_faults(e.where("price >= 2"), F.sha2("body", 256)).where("fault is not null")
    return rows.groupBy("log", "fault").agg(F.count("*").alias("n"))


@query(with_(TICKS_SQL, f""", m AS (SELECT producer % 10 AS producer, ns // {DAY} AS d, min(off) AS a, max(off) AS b FROM ticks GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY d) AS k, count(*) OVER (PARTITION BY producer) AS n FROM m)
SELECT producer, CASE WHEN producer = 7 AND k = 1 THEN 'self' WHEN producer = 3 AND k = 2 THEN 'epoch' WHEN producer = 5 AND k = n THEN 'global' ELSE 'ok' END AS level, count(*) AS n FROM (SELECT producer, k, n FROM r) GROUP BY 1, 2"""))
def l4_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Daily manifests of ten producers by arrival: 7 has an inverted first one, 3 a second one that names no predecessor, 5 a wrong checkpoint."""
    t = ticks(spark, sf).select((F.col("producer") % 10).alias("producer"), F.expr(f"ns div {DAY}").alias("d"), "ns", "offset")
    t = t.withColumn("at", F.row_number().over(W.partitionBy("producer").orderBy("ns", "offset")).cast("bigint"))  # offsets as this producer gave them
    m = t.groupBy("producer", "d").agg(F.min("at").alias("a"), F.max("at").alias("b")).withColumn("epoch", F.lit("e1"))
    w = W.partitionBy("producer").orderBy("d")
    m = m.withColumn("sequence", F.row_number().over(w)).withColumn("own", F.sha2(F.concat_ws("|", F.col("producer").cast("string"), F.col("d").cast("string")), 256))
    odd = (F.col("producer") == 7) & (F.col("sequence") == 1)
    previous = F.when((F.col("producer") == 3) & (F.col("sequence") == 2), "0" * 64).otherwise(F.coalesce(F.lag("own").over(w), F.lit("0" * 64)))
    m = m.select("producer", "epoch", "sequence", previous.alias("previous"), "own", F.when(odd, F.col("b") + 1).otherwise(F.col("a")).alias("first_offset"), F.col("b").alias("last_offset"))
    ends = m.groupBy("producer", "epoch").agg((F.max("last_offset") + (F.first("producer") == 5).cast("int")).alias("offset"))
    return forecasts.continuity(m, ends).groupBy("producer", F.coalesce("level", F.lit("ok")).alias("level")).agg(F.count("*").alias("n"))


@query(with_(TICKS_SQL, """, h AS (SELECT CAST('0x' || substr(sha256('{"series":"' || series || '","offset":' || off || ',"ns":' || ns || '}'), 1, 15) AS BIGINT) AS h FROM ticks)
SELECT count(*) AS records, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, CAST(bit_xor(h) AS VARCHAR) AS hash_xor FROM h"""))
def l5_table_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Order-insensitive: sum and exclusive or of row hashes, combined in the tasks."""
    return archive.content_digest(ticks(spark, sf).select("series", "offset", "ns"))


@query(with_(TICKS_SQL, f""", t AS (SELECT ns // {DAY} AS snapshot, series || '/' || (ns // {DAY}) AS m, series || '/' || (ns // {6 * H}) AS o FROM ticks)
SELECT snapshot, kind, count(DISTINCT root) AS n FROM (SELECT snapshot, 'manifest' AS kind, m AS root FROM t UNION ALL SELECT snapshot, 'object', o FROM t UNION ALL SELECT snapshot, 'object', 'day/' || snapshot FROM t) GROUP BY 1, 2"""))
def l8_retention_roots(spark: SparkSession, sf: str) -> DataFrame:
    day, part = F.expr(f"ns div {DAY}"), F.expr(f"ns div {6 * H}")
    m = ticks(spark, sf).groupBy(day.alias("snapshot"), "series").agg(F.collect_set(F.concat_ws("/", "series", part.cast("string"))).alias("objects"))  # four a day
    inputs = F.struct(F.concat_ws("/", "series", F.col("snapshot").cast("string")).alias("manifest"), "objects")
    s = m.groupBy("snapshot").agg(F.collect_list(inputs).alias("inputs")).withColumn("parquet_sha256", F.concat(F.lit("day/"), F.col("snapshot").cast("string")))
    return forecasts.retention_roots(s).groupBy("snapshot", "kind").agg(F.count("*").alias("n"))


@query(with_(TICKS_SQL, f""", m AS (SELECT series, ns // {DAY} AS d, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT series, CASE WHEN d % 10 = 3 AND series = 'view' THEN 'missing-object' WHEN d % 10 = 4 THEN 'record-count' WHEN d % 10 = 5 THEN 'not-in-manifest' ELSE 'ok' END AS state, count(*) AS n FROM m GROUP BY 1, 2"""))
def l9_object_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of a day against their manifests: some lie in no manifest, some are gone, some have another count."""
    t = ticks(spark, sf).withColumn("d", F.expr(f"ns div {DAY}"))
    manifest = t.groupBy("series", "d").agg((F.count("*") + (F.first("d") % 10 == 4).cast("int")).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")).where("d % 10 <> 5")
    kept = t.where("not (d % 10 = 3 and series = 'view')").withColumn("fault", F.lit(None).cast("string"))
    return archive.audited(kept, manifest, ["series", "d"]).groupBy("series", "state").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_custkey AS trial, o_orderkey AS sequence, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' ELSE 'b' END AS config, CASE o_orderstatus WHEN 'F' THEN 'registered' WHEN 'O' THEN 'started' ELSE 'completed' END AS phase FROM orders),
born AS (SELECT trial, min(sequence) AS s, arg_min(config, sequence) AS c FROM e WHERE phase = 'registered' GROUP BY 1 ORDER BY 2 LIMIT 8),
j AS (SELECT e.*, coalesce(e.sequence >= s, false) AS since, coalesce(e.sequence >= s AND config <> c, false) AS wrong FROM e LEFT JOIN born USING (trial)),
k AS (SELECT *, row_number() OVER (PARTITION BY trial, since AND NOT wrong, config, phase ORDER BY sequence) > 1 AS again FROM j),
d AS (SELECT *, CASE WHEN wrong THEN 'identity-conflict' WHEN since AND again THEN 'repeat' WHEN since THEN 'due' WHEN phase = 'registered' THEN 'budget-exhausted' ELSE 'not-registered' END AS o FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY o, phase ORDER BY sequence) AS rk FROM d)
SELECT phase, CASE WHEN o = 'due' AND phase <> 'completed' AND rk > 8 THEN 'budget-exhausted' WHEN o = 'due' THEN 'appended' ELSE o END AS outcome, count(*) AS n FROM r GROUP BY 1, 2""")
def l10_trials(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trial"), F.col("o_orderkey").alias("sequence"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "a").otherwise("b").alias("config"),
        F.when(F.col("o_orderstatus") == "F", "registered").when(F.col("o_orderstatus") == "O", "started").otherwise("completed").alias("phase"), F.lit(1).alias("attempt"))
    return forecasts.trials(o).groupBy("phase", "outcome").agg(F.count("*").alias("n"))


# ---- coverage, clocks, batches -----------------------------------------------------------------------------
@query(with_(BARS_SQL, f""", g AS (SELECT series, CASE WHEN finalized THEN start_ns + {H} ELSE start_ns END AS s, lead(start_ns) OVER (PARTITION BY series ORDER BY start_ns) AS e FROM bars),
l AS (SELECT series, CASE series WHEN 'click' THEN 'trade' WHEN 'view' THEN 'book' WHEN 'error' THEN 'periodic' ELSE 'candle' END AS family, CASE series WHEN 'signup' THEN 'coverage-loss' ELSE 'backfill' END AS recovery, s, e FROM g WHERE e > s OR e IS NULL)
SELECT series, family, CASE WHEN family = 'candle' AND recovery = 'backfill' AND e IS NOT NULL THEN 'pending' WHEN family IN ('trade', 'liquidation', 'book') THEN 'unrecoverable' ELSE 'unknown' END AS status, count(*) AS n FROM l GROUP BY 1, 2, 3"""))
def h4_loss_status(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps as losses of each series' family; the last span of a series is open."""
    b = bars(spark, sf)
    closed = coverage.candle_gaps(b).select("series", F.col("gap_end").alias("end_ns"))
    open_ = b.select("series").distinct().withColumn("end_ns", F.lit(None).cast("bigint"))
    family = F.when(F.col("series") == "click", "trade").when(F.col("series") == "view", "book").when(F.col("series") == "error", "periodic").otherwise("candle")
    rows = closed.union(open_).withColumn("family", family).withColumn("recovery", F.when(F.col("series") == "signup", "coverage-loss").otherwise("backfill"))
    return forecasts.loss_status(rows).groupBy("series", "family", "status").agg(F.count("*").alias("n"))


STEP, GAP = 1_000_000, 3 * H


@query(with_(TICKS_SQL, f""", s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ns, off) AS o, ns // {10 * DAY} AS sess, ns AS wall, ns + CASE WHEN price > 500 THEN 5000000 ELSE 0 END AS mono, ns + CASE WHEN price > 500 THEN 5000000 ELSE 0 END + CASE WHEN price < 3 THEN 4000000 ELSE 0 END AS boot, CASE WHEN price > 300 THEN 'degraded' ELSE 'healthy' END AS status FROM ticks),
d AS (SELECT *, wall - lag(wall) OVER w AS dw, mono - lag(mono) OVER w AS dm, boot - lag(boot) OVER w AS db, lag(sess) OVER w AS ls, lag(status) OVER w AS lst FROM s WINDOW w AS (PARTITION BY series ORDER BY o)),
k AS (SELECT *, CASE WHEN ls <> sess THEN 'session_changed' WHEN dm < 0 OR db < 0 THEN 'monotonic_regression' WHEN abs(db - dm) > {STEP + 2000} THEN 'suspend' WHEN abs(dw - dm) > {STEP + 2000} THEN 'clock_step' WHEN dm > {GAP} THEN 'sampling_gap' END AS disruption FROM d)
SELECT series AS clock, coalesce(disruption, 'none') AS disruption, count(*) AS n, CAST(max(e) AS BIGINT) AS last_epoch FROM (SELECT *, sum(CASE WHEN disruption IS NOT NULL OR coalesce(status <> lst, true) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY o) AS e FROM k) GROUP BY 1, 2"""))
def f13_clock_epochs(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    mono = F.col("ns") + F.when(F.col("price") > 500, 5_000_000).otherwise(0)
    samples = t.select(
        F.col("series").alias("clock"), F.struct("ns", "offset").alias("order"), F.expr(f"ns div {10 * DAY}").alias("session"), F.col("ns").alias("wall_ns"), mono.alias("mono_ns"),
        (mono + F.when(F.col("price") < 3, 4_000_000).otherwise(0)).alias("boot_ns"), F.lit(1000).alias("unc_ns"), F.when(F.col("price") > 300, "degraded").otherwise("healthy").alias("status"))
    rows = forecasts.clock_epochs(samples, STEP, GAP)
    return rows.groupBy("clock", F.coalesce("disruption", F.lit("none")).alias("disruption")).agg(F.count("*").alias("n"), F.max("epoch").alias("last_epoch"))


@query(f"""WITH RECURSIVE {TICKS_SQL}, r AS (SELECT series, ns // {DAY} AS day, off, CAST(floor(price) AS BIGINT) AS b, row_number() OVER (PARTITION BY series, ns // {DAY} ORDER BY off) AS k FROM ticks),
f AS (SELECT series, day, k, off, 0 AS batch, 1 AS n, b AS size FROM r WHERE k = 1
UNION ALL SELECT r.series, r.day, r.k, r.off, CASE WHEN f.n + 1 > 20 OR f.size + r.b > 1000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n + 1 > 20 OR f.size + r.b > 1000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 20 OR f.size + r.b > 1000 THEN r.b ELSE f.size + r.b END
FROM f JOIN r ON r.series = f.series AND r.day = f.day AND r.k = f.k + 1) SELECT series, day, off AS "offset", batch FROM f""")
def f11_byte_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of at most 20 records and 1,000 bytes (the price, rounded down) within a series' day."""
    t = ticks(spark, sf).select("series", F.expr(f"ns div {DAY}").alias("day"), "offset", F.floor("price").alias("n_bytes"))
    return forecasts.byte_batches(t, ["series", "day"], 20, 1000)


@query(with_(BARS_SQL, f""", a AS (SELECT series, start_ns AS s, start_ns + {5 * H} AS e, 'pending' AS st FROM bars WHERE NOT finalized), b AS (SELECT series, start_ns AS s, start_ns + {2 * H} AS e, CASE WHEN n < 2 THEN 'unknown' ELSE 'complete' END AS st FROM bars)
SELECT series, s // {DAY} AS day, count(*) AS n_claims, string_agg(DISTINCT st, ',' ORDER BY st) AS statuses FROM (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) GROUP BY 1, 2"""))
def g5_claim_union(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of two sources, overlaps kept, equal ones once."""
    b = bars(spark, sf)
    one = b.where(~F.col("finalized")).select("series", F.col("start_ns").alias("claim_start"), (F.col("start_ns") + 5 * H).alias("claim_end"), F.lit("pending").alias("status"))
    two = b.select("series", F.col("start_ns").alias("claim_start"), (F.col("start_ns") + 2 * H).alias("claim_end"), F.when(F.col("n") < 2, "unknown").otherwise("complete").alias("status"))
    both = coverage.united(one, two)
    return both.groupBy("series", F.expr(f"claim_start div {DAY}").alias("day")).agg(F.count("*").alias("n_claims"), F.concat_ws(",", F.sort_array(F.collect_set("status"))).alias("statuses"))

