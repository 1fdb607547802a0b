"""Queries over grids of horizons, policies and chains (B15, J4, J5, J6, J21). The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import CLAIMS, ORIGIN_SQL, SPLITS, T0, H, claims_of, query, with_
from tidemark.functions import expressions as X
from tidemark.operators import contracts, grids
from tidemark.sources.scratch import fresh
from tidemark.sources.views import BARS_SQL, bars

#: Horizon, cadence and block in hours; the first split has no embargo.
GRID = [(1, 1, 6), (4, 2, 24), (6, 3, 48)]
GRID_VALUES = ", ".join(f"({h}, {c}, {k})" for h, c, k in GRID)
EMBARGOED = [(n, a, b, 0 if n == "train" else 24 * H) for n, a, b in SPLITS]
EMBARGO_VALUES = ", ".join(f"('{n}', {a}, {b}, {e})" for n, a, b, e in EMBARGOED)
LOOKBACK_HOURS = 12
TRAIN, LATE = SPLITS[0], 60_000_000_000
SPLIT_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPLITS)


@query(f"WITH RECURSIVE {BARS_SQL}" + ORIGIN_SQL + f""", c AS (SELECT e.series, e.first_start, s.*, g.*, unnest(range((s.lo + g.cadence * {H} - 1) // (g.cadence * {H}) * (g.cadence * {H}), s.hi, g.cadence * {H})) AS origin_ns
  FROM (SELECT series, min(start_ns) AS first_start FROM bars GROUP BY 1) e CROSS JOIN (VALUES {EMBARGO_VALUES}) s(split, lo, hi, embargo) CROSS JOIN (VALUES {GRID_VALUES}) g(horizon, cadence, block)),
f AS (SELECT c.*, (origin_ns < lo + embargo OR origin_ns - {LOOKBACK_HOURS * H} < first_start OR origin_ns + horizon * {H} >= hi) AS excluded, (SELECT count(*) FROM bars b WHERE b.series = c.series AND b.finalized AND b.start_ns >= c.origin_ns AND b.start_ns < c.origin_ns + c.horizon * {H}) AS there FROM c),
t AS (SELECT f.*, NOT excluded AND o.origin_ns IS NOT NULL AND o.reason IS NULL AS fit, NOT excluded AND o.origin_ns IS NOT NULL AND o.reason IS NULL AND there = horizon AS matured FROM f LEFT JOIN o ON o.series = f.series AND o.origin_ns = f.origin_ns),
r AS (SELECT series, split, horizon, block, min(origin_ns) AS s FROM t WHERE matured GROUP BY 1, 2, 3, 4 UNION ALL SELECT r.series, r.split, r.horizon, r.block, (SELECT min(origin_ns) FROM t WHERE t.matured AND t.series = r.series AND t.split = r.split AND t.horizon = r.horizon AND t.origin_ns >= r.s + r.block * {H}) FROM r WHERE r.s IS NOT NULL),
k AS (SELECT series, split, horizon, count(s) AS blocks FROM r GROUP BY 1, 2, 3),
n AS (SELECT series, split, horizon, count(*) AS candidates, count(*) FILTER (WHERE NOT excluded) AS structurally_eligible, count(*) FILTER (WHERE fit) AS origin_eligible, count(*) FILTER (WHERE matured) AS matured FROM t GROUP BY 1, 2, 3)
SELECT n.*, coalesce(blocks, 0) AS blocks, CASE WHEN structurally_eligible = 0 THEN 0 ELSE round(matured / structurally_eligible, 8) END AS completeness FROM n LEFT JOIN k USING (series, split, horizon)""")
def j4_horizon_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Three horizons with a cadence and a block length each: what is left of the candidates at each step."""
    return grids.horizon_counts(grids.horizon_states(bars(spark, sf), EMBARGOED, GRID, LOOKBACK_HOURS))


FOLDS = [("training", TRAIN[1], TRAIN[2], TRAIN[2], True), ("evaluation", SPLITS[1][1], SPLITS[1][2], SPLITS[1][2], False)]
FOLD_VALUES = ", ".join(f"('{m}', {a}, {b}, {c}, {str(t).lower()})" for m, a, b, c, t in FOLDS)
COMMON = [(1, 1), (2, 2), (6, 3)]
COMMON_LAGS = 3


@query(with_(BARS_SQL, f""", gaps AS (SELECT h.start_ns FROM (SELECT unnest(range({T0}, {SPLITS[2][2]} + {25 * H}, {H})) AS start_ns) h LEFT JOIN bars b ON b.start_ns = h.start_ns GROUP BY 1 HAVING count(b.series) < (SELECT count(DISTINCT series) FROM bars)),
p AS (SELECT *, unnest(range(lo, hi, cadence * {H})) AS origin_ns FROM (VALUES {FOLD_VALUES}) f(mode, lo, hi, cut, training) CROSS JOIN (VALUES {', '.join(map(str, COMMON))}) g(horizon, cadence))
SELECT mode, horizon, origin_ns, CASE WHEN origin_ns + horizon * {H} + {LATE} >= cut THEN 'immature-or-boundary-label' WHEN (origin_ns - {T0}) // {H} - 1 < {COMMON_LAGS} THEN 'missing-feature-history'
  WHEN NOT training AND origin_ns - {COMMON_LAGS * H} <= {TRAIN[2] + 24 * H} THEN 'purge-or-embargo'
  WHEN EXISTS (SELECT 1 FROM gaps WHERE gaps.start_ns >= origin_ns - {(COMMON_LAGS + 1) * H} AND gaps.start_ns < origin_ns + horizon * {H}) THEN 'incomplete-common-pair' ELSE 'selected' END AS state FROM p"""))
def j5_common_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Training and evaluation origins at three cadences, each with the features of four hours and a label of its own length."""
    return grids.common_eligibility(bars(spark, sf), T0, FOLDS, COMMON, COMMON_LAGS, 24 * H, LATE, TRAIN[2])


CHAIN_LAGS, CHAIN_STEPS, DELAY, RADIUS = 2, 2, 1_000_000, 1000
FEATURES_SQL, LABEL_SQL = f"x.start_ns BETWEEN r.start_ns - {CHAIN_LAGS * H} AND r.start_ns", f"x.start_ns BETWEEN r.start_ns + {H} AND r.start_ns + {CHAIN_STEPS * H}"


def facts_sql(where: str) -> str:
    return f"SELECT r.series, r.start_ns, count(x.series) AS n, bool_and(x.finalized) AS final, bool_and(x.av IS NOT NULL) AS dated, max(x.av) AS av, bool_and(x.cov) AS cov FROM r LEFT JOIN r x ON x.series = r.series AND {where} GROUP BY 1, 2"


@query(with_(BARS_SQL, f""", c AS ({CLAIMS}), s AS (SELECT series, start_ns AS span_start, start_ns + {H} AS span_end FROM bars),
w AS (SELECT s.*, c.claim_end, c.status, claim_start > coalesce(max(claim_end) OVER (PARTITION BY s.series, span_start ORDER BY claim_start, claim_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), span_start) AS hole FROM s JOIN c ON s.series = c.series AND span_start < claim_end AND claim_start < span_end),
d AS (SELECT series, span_start AS start_ns, bool_and(status = 'complete') AND NOT bool_or(hole) AND max(claim_end) >= max(span_end) AS cov FROM w GROUP BY 1, 2),
r AS (SELECT b.series, b.start_ns, finalized, CASE WHEN (b.start_ns // {H}) % 24 <> 11 THEN b.start_ns + {H} + CASE WHEN (b.start_ns // {H}) % 24 = 7 THEN {2 * H} ELSE 5000 END END AS av, coalesce(cov, false) AS cov FROM bars b LEFT JOIN d USING (series, start_ns)),
f AS ({facts_sql(FEATURES_SQL)}), l AS ({facts_sql(LABEL_SQL)}),
q AS (SELECT r.*, start_ns + {H + DELAY} AS o, f.n AS fn, f.final AS ff, f.dated AS fd, f.av AS fa, f.cov AS fc, l.n AS ln, l.final AS lf, l.dated AS ld, l.av AS la, l.cov AS lc FROM r JOIN f USING (series, start_ns) JOIN l USING (series, start_ns)),
p AS (SELECT q.*, s.split AS part, s.hi AS boundary, NOT fd OR fa > o - {RADIUS} AS late, start_ns + {(1 + CHAIN_STEPS) * H} AS e FROM q LEFT JOIN (VALUES {SPLIT_VALUES}) s(split, lo, hi) ON o - {RADIUS} >= lo AND o + {RADIUS} < hi)
SELECT series, start_ns, part, CASE WHEN part IS NULL THEN 'outside-or-crossing-split' WHEN NOT finalized THEN 'not-finalized' WHEN fn < {CHAIN_LAGS + 1} THEN 'lag-gap-or-missing' WHEN NOT ff THEN 'lag-not-finalized'
  WHEN NOT fc OR late THEN concat_ws(',', CASE WHEN NOT fc THEN 'coverage' END, CASE WHEN late THEN 'feature-unavailable' END, CASE WHEN NOT fd THEN 'time-quality' END)
  WHEN ln = {CHAIN_STEPS} AND lf AND e <= o + {RADIUS} THEN 'label-not-future' WHEN ln = {CHAIN_STEPS} AND lf AND e >= boundary THEN 'label-purged' WHEN ln < {CHAIN_STEPS} THEN 'label-gap-or-missing' WHEN NOT lf THEN 'label-not-finalized'
  WHEN NOT ld OR la > boundary - 1 - {RADIUS} THEN 'label-availability-purged' WHEN NOT lc THEN 'label-coverage' ELSE 'case' END AS reason FROM p"""))
def j6_chained_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Two lags and a label of two steps under the coverage that claims prove; receipts as in j6_replay_cases."""
    b = bars(spark, sf)
    h = F.expr(f"start_ns div {H} % 24")
    known = F.when(h != 11, F.col("start_ns") + H + F.when(h == 7, 2 * H).otherwise(5000))
    rows = b.select("series", "start_ns", "finalized", known.alias("available_ns"))
    return grids.chained_cases(rows, claims_of(b)[1], SPLITS, DELAY, RADIUS, CHAIN_LAGS, CHAIN_STEPS)


@query(with_(BARS_SQL, f""", d AS (SELECT series, start_ns // {X.DAY_NS} AS day, min(start_ns) AS first_ns, max(start_ns) AS last_ns FROM bars GROUP BY 1, 2)
SELECT series, day, op AS operation, CASE WHEN op = 'read' AND last_ns < {SPLITS[2][1]} THEN 'access_allowed' ELSE 'access_denied' END AS access FROM d CROSS JOIN (SELECT unnest(['read', 'build', 'evaluate']) AS op)"""))
def j21_access_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of requests for each series' days, each judged and appended; the result is the log as it lies on disk."""
    d = bars(spark, sf).groupBy("series", F.expr(f"start_ns div {X.DAY_NS}").alias("day")).agg(F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns"))
    path = fresh(spark, "access-log")
    for operation in ("read", "build", "evaluate"):
        asked = d.withColumns({"operation": F.lit(operation), "label_ns": F.lit(H if operation == "evaluate" else 0)})
        schema = grids.logged(asked, SPLITS[2][1], path).schema
    return spark.read.schema(schema).parquet(path).select("series", "day", "operation", "access")


MODES = [(f, t, c) for f in (True, False) for t in ("exclude", "include", "require") for c in ("exclude", "include", "require")]
MODE_VALUES = ", ".join(f"({str(f).lower()}, '{t}', '{c}')" for f, t, c in MODES)


@query(with_(BARS_SQL, f""", q AS (SELECT series, finalized, (start_ns // {H}) % 24 <> 11 AS healthy, (start_ns // {H}) % 24 NOT IN (15, 16, 17) AS covered FROM bars), m(fo, tq, cv) AS (VALUES {MODE_VALUES}),
r AS (SELECT series, fo, tq, cv, CASE WHEN fo AND NOT finalized THEN 'not-finalized' WHEN tq <> 'include' AND NOT healthy THEN CASE tq WHEN 'exclude' THEN 'time-quality' ELSE 'stops:time-quality' END WHEN cv <> 'include' AND NOT covered THEN CASE cv WHEN 'exclude' THEN 'coverage' ELSE 'stops:coverage' END END AS reason FROM q CROSS JOIN m)
SELECT series, fo AS finalized_only, tq AS time_quality, cv AS coverage, reason, count(*) AS n FROM r GROUP BY 1, 2, 3, 4, 5"""))
def b15_policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All eighteen policies in one scan, those that require something included: what would stop the job is told as a reason."""
    h = F.expr(f"start_ns div {H} % 24")
    rows = bars(spark, sf).select("series", "finalized", (h != 11).alias("healthy"), F.when(h.isin(15, 16, 17), "pending").otherwise("complete").alias("status"))
    return contracts.policies(rows, MODES).groupBy("series", "finalized_only", "time_quality", "coverage", "reason").agg(F.count("*").alias("n"))
