"""Eligibility over grids of horizons in one plan: J4 and J5 with a cadence a horizon, J6 with chains of several steps, J21's log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import HOUR_NS
from tidemark.operators import coverage, replay, scores
from tidemark.operators.scan import BLOCK_HOURS, haloed, prefix
from tidemark.sources.scratch import durable


def horizon_states(bars: DataFrame, splits: list[tuple[str, int, int, int]], grid: list[tuple[int, int, int]], lookback_hours: int) -> DataFrame:
    """Series, split, horizon, block, origin_ns and state of every origin that a horizon's cadence puts into a split.

    splits are (name, start, end, embargo) in ns, grid (horizon, cadence, block) in hours. State: the structural reason, else the
    origin's, else outcome-missing, else matured. A label of any length is whole if the next fault as seen from its first
    hour lies behind it, so one join serves all horizons. Splits and horizons are literals, a struct a pair.
    """
    pairs = [F.struct(F.lit(n).alias("split"), F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi"), F.lit(e).cast("bigint").alias("embargo"), F.lit(h).alias("horizon"), F.lit(c * HOUR_NS).cast("bigint").alias("cadence"), F.lit(k).alias("block")) for n, a, b, e in splits for h, c, k in grid]
    ends = bars.groupBy("series").agg(F.min("start_ns").alias("first_start"), F.max("start_ns").alias("last_start"))
    rows = ends.select("series", "first_start", "last_start", F.explode(F.array(*pairs)).alias("p")).select("series", "first_start", "last_start", "p.*")
    first = F.expr("(lo + cadence - 1) div cadence * cadence")
    rows = rows.where(first < F.col("hi")).withColumn("origin_ns", F.explode(F.sequence(first, F.col("hi") - 1, F.col("cadence"))))
    known = scores.origins(bars, lookback_hours).select("series", "origin_ns", F.coalesce("reason", F.lit("")).alias("_origin"))
    ahead = scores.next_faults(bars).select("series", F.col("start_ns").alias("origin_ns"), F.lit(True).alias("_there"), F.col("fault.start_ns").alias("_fault"))
    rows = rows.join(known, ["series", "origin_ns"], "left").join(ahead, ["series", "origin_ns"], "left")
    o, end = F.col("origin_ns"), F.col("origin_ns") + F.col("horizon") * F.lit(HOUR_NS)
    structural = replay.structural_reason(o, F.col("lo"), F.col("hi"), F.col("embargo"), F.col("first_start"), F.lit(lookback_hours * HOUR_NS), end - o)
    whole = F.col("_there").isNotNull() & (F.col("last_start") + HOUR_NS >= end) & F.coalesce(F.col("_fault") >= end, F.lit(True))
    state = F.coalesce(structural, F.when(F.col("_origin").isNull(), "missing").when(F.col("_origin") != "", F.col("_origin")), F.when(~whole, "outcome-missing"), F.lit("matured"))
    is_structural = structural.isNotNull()
    return rows.select("series", "split", "horizon", "block", "origin_ns", is_structural.alias("excluded"), state.alias("state"))


def horizon_counts(states: DataFrame) -> DataFrame:
    """A row for each series, split and horizon: candidates, what is left at each step, and blocks of matured origins a block apart.

    Blocks are counted a block length at a time, as the chain's step is one number.
    """
    states = durable(states, "horizon-states")
    keys = ["series", "split", "horizon"]
    fine = ~F.col("excluded")
    counts = states.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(fine).alias("structurally_eligible"), F.count_if(fine & F.col("state").isin("outcome-missing", "matured")).alias("origin_eligible"), F.count_if(F.col("state") == "matured").alias("matured"))
    lengths = sorted(r.block for r in states.select("block").distinct().collect())  # the grid's few lengths
    matured = states.where("state = 'matured'").select(*keys, "block", F.col("origin_ns").alias("start_ns"))
    found = reduce(DataFrame.union, [scores.blocks(matured.where(F.col("block") == n), keys, n * HOUR_NS) for n in lengths])
    share = F.round(F.coalesce(F.try_divide("matured", "structurally_eligible"), F.lit(0.0)), 8)
    return counts.join(found, keys, "left").select(*counts.columns, F.coalesce("blocks", F.lit(0)).cast("bigint").alias("blocks"), share.alias("completeness"))


def common_eligibility(bars: DataFrame, base_ns: int, folds: list[tuple[str, int, int, int, bool]], grid: list[tuple[int, int]], lags: int, embargo_ns: int, delay_ns: int, fit_cutoff_ns: int) -> DataFrame:
    """Mode, horizon, origin_ns and state of every common origin; each horizon has its own cadence.

    folds are (mode, start, end, cutoff, training), grid (horizon, cadence) in hours. An hour that any series lacks spoils the
    origins whose features or label cover it: the next such hour as seen from an origin's first feature hour tells it.
    """
    spark = bars.sparkSession
    last = max(end for _, _, end, _, _ in folds) + max(h for h, _ in grid) * HOUR_NS
    every = bars.agg(F.count_distinct("series").alias("every"))
    have = bars.groupBy("start_ns").agg(F.count_distinct("series").alias("have"))
    hours = spark.range(1).select(F.explode(F.sequence(F.lit(base_ns), F.lit(last), F.lit(HOUR_NS))).alias("start_ns"))
    hours = hours.join(have, "start_ns", "left").crossJoin(F.broadcast(every)).withColumn("_all", F.lit(0))  # every is one row
    gap = F.when(F.coalesce("have", F.lit(0)) < F.col("every"), F.col("start_ns"))
    gaps = prefix(hours, ["_all"], "start_ns", BLOCK_HOURS * HOUR_NS, {"gap": (F.min, gap)}, reverse=True).select(F.col("start_ns").alias("_from"), "gap")
    pairs = [F.struct(F.lit(m).alias("mode"), F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi"), F.lit(c).cast("bigint").alias("cut"), F.lit(t).alias("training"), F.lit(h).alias("horizon"), F.lit(k * HOUR_NS).cast("bigint").alias("cadence")) for m, a, b, c, t in folds for h, k in grid]
    rows = spark.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("lo < hi")
    rows = rows.withColumn("origin_ns", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.col("cadence")))).withColumn("_from", F.col("origin_ns") - (lags + 1) * HOUR_NS)
    o = F.col("origin_ns")
    end = o + F.col("horizon") * F.lit(HOUR_NS)
    place = F.floor((o - base_ns) / F.lit(HOUR_NS)) - 1
    state = (
        F.when(end + delay_ns >= F.col("cut"), "immature-or-boundary-label").when(place < lags, "missing-feature-history")
        .when(~F.col("training") & (o - lags * HOUR_NS <= fit_cutoff_ns + embargo_ns), "purge-or-embargo").when(F.col("gap") < end, "incomplete-common-pair").otherwise("selected")
    )
    return rows.join(gaps, "_from", "left").select("mode", "horizon", "origin_ns", state.alias("state"))


def chained_cases(rows: DataFrame, claims: DataFrame, splits: list[tuple[str, int, int]], delay_ns: int, radius_ns: int, lags: int, steps: int) -> DataFrame:
    """rows(series, start_ns, finalized, available_ns or null) and claims of coverage; features are the row and ``lags`` hours before
    it, the label ``steps`` hours behind it.

    part and reason of every row: ``case`` or the first thing against it, features before the label. Coverage is H5's status of
    each hour. Where quality and availability both speak, all are listed in order, for features and label alike.
    """
    spans = rows.select("series", F.col("start_ns").alias("span_start"), (F.col("start_ns") + HOUR_NS).alias("span_end"))
    status = coverage.coverage_status(spans, claims).select("series", F.col("span_start").alias("start_ns"), (F.col("status") == "complete").alias("covered"))
    rows = rows.join(status, ["series", "start_ns"])
    facts = {"n": F.count("*"), "final": F.bool_and("finalized"), "dated": F.bool_and(F.col("available_ns").isNotNull()), "available": F.max("available_ns"), "covered_all": F.bool_and("covered")}
    near = haloed(rows, "start_ns", BLOCK_HOURS * HOUR_NS, lags * HOUR_NS, steps * HOUR_NS)
    w = W.partitionBy("series", "_block").orderBy("start_ns")
    sides = {"f": w.rangeBetween(-lags * HOUR_NS, 0), "l": w.rangeBetween(HOUR_NS, steps * HOUR_NS)}
    own = near.withColumns({f"{s}_{n}": c.over(over) for s, over in sides.items() for n, c in facts.items()}).where("_own")
    origin = F.col("start_ns") + HOUR_NS + delay_ns
    inside = [((origin - radius_ns >= lo) & (origin + radius_ns < hi), name, hi) for name, lo, hi in splits]
    own = own.withColumns({"part": F.coalesce(*[F.when(i, F.lit(n)) for i, n, _ in inside]), "boundary": F.coalesce(*[F.when(i, F.lit(hi)) for i, _, hi in inside])})

    def listed(*found: tuple[Column, str]) -> Column:
        return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in found]), lambda x: x.isNotNull()), ",")

    late = ~F.col("f_dated") | (F.col("f_available") > origin - radius_ns)
    features = listed((~F.col("f_covered_all"), "coverage"), (late, "feature-unavailable"), (~F.col("f_dated"), "time-quality"))
    label = listed((~F.col("l_covered_all"), "label-coverage"))
    whole, end = F.col("l_n") == steps, F.col("start_ns") + (1 + steps) * HOUR_NS
    ready = whole & F.col("l_final")
    reason = (
        F.when(F.col("part").isNull(), "outside-or-crossing-split").when(~F.col("finalized"), "not-finalized").when(F.col("f_n") < lags + 1, "lag-gap-or-missing").when(~F.col("f_final"), "lag-not-finalized").when(features != "", features)
        .when(ready & (end <= origin + radius_ns), "label-not-future").when(ready & (end >= F.col("boundary")), "label-purged").when(~whole, "label-gap-or-missing").when(~F.col("l_final"), "label-not-finalized")
        .when(~F.col("l_dated") | (F.col("l_available") > F.col("boundary") - 1 - radius_ns), "label-availability-purged").when(label != "", label).otherwise("case")
    )
    return own.select("series", "start_ns", "part", reason.alias("reason"))


def logged(requests: DataFrame, reserved_from_ns: int, path: str) -> DataFrame:
    """The requests judged, appended to the log at ``path`` and read back; the log is written before anything is denied.

    The judgements are one append, so a retried task adds no row twice; ``path`` lies in the shared folder.
    """
    judged = durable(replay.guarded(requests, reserved_from_ns), "judged")
    judged.write.mode("append").parquet(path)
    return judged


def admitted(requests: DataFrame, reserved_from_ns: int, path: str) -> DataFrame:
    """The requests if all are allowed; else an error, and the log tells which were not."""
    judged = logged(requests, reserved_from_ns, path)
    if denied := judged.where("access = 'access_denied'").count():
        raise PermissionError(f"{denied} requests for reserved, labelled or unqualified ranges denied, see {path}")
    return judged.drop("access")
