"""Policies, contracts and figures over rows of any size: no caps, one pass each where the rule allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import HOUR_NS, fits_decimal, is_digest
from tidemark.operators.derive import chained
from tidemark.operators.scores import next_faults

#: The closed schema of a normalized archive: 48 names and types, fixed.
NORMALIZED_SCHEMA = (
    "producer string, epoch string, offset bigint, predecessor_epoch string, predecessor_offset bigint, raw_sha256 string, kind string, semantic_revision string, rejection_code string, rejection_field string, "
    "input_schema_name string, input_schema_major bigint, input_schema_minor bigint, instrument_schema_name string, instrument_schema_major bigint, instrument_schema_minor bigint, output_schema_name string, output_schema_major bigint, output_schema_minor bigint, "
    "instrument_revision string, normalizer_version string, receipt_wall_time_ns bigint, receipt_monotonic_ns bigint, receipt_session_id string, quality_status string, quality_offset_ns bigint, quality_uncertainty_ns bigint, quality_evidence_age_ns bigint, normalized_at_ns bigint, "
    "venue string, category string, symbol string, start_ns bigint, interval_ns bigint, open string, high string, low string, close string, volume string, volume_unit string, finalized boolean, "
    "source_time_value bigint, source_time_unit string, source_event_id string, source_sequence bigint, publication_time_value bigint, publication_time_unit string, quality_flags array<string>"
)


def in_schema(rows: DataFrame, given: dict[str, Column], schema: str) -> DataFrame:
    """rows in a closed schema: the columns given, null for the others, each cast to its type; a name beyond it is an error."""
    names = [part.split(" ", 1) for part in schema.split(", ")]
    if extra := given.keys() - {n for n, _ in names}:
        raise ValueError(f"not in the schema: {sorted(extra)}")
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def accepted(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """incoming(keys, digest) with outcome new, same or conflict against known(keys, digest)."""
    rows = incoming.join(known.withColumnRenamed("digest", "_known"), keys, "left")
    return rows.withColumn("outcome", F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("digest"), "same").otherwise("conflict")).drop("_known")


def policy(rows: DataFrame, finalized_only: bool, time_quality: str, coverage: str) -> DataFrame:
    """rows(finalized, healthy, status) with the first reason against each, null if kept.

    time_quality and coverage are include, exclude or require: what require finds stops the job.
    """
    bad_time, bad_cover = ~F.col("healthy"), F.col("status") != "complete"
    stop = lambda text: F.raise_error(F.lit(text)).cast("string")
    reason = F.when(F.lit(finalized_only) & ~F.col("finalized"), "not-finalized")
    for mode, bad, name in ((time_quality, bad_time, "time-quality"), (coverage, bad_cover, "coverage")):
        if mode == "exclude":
            reason = reason.when(bad, name)
        elif mode == "require":
            reason = reason.when(bad, stop(f"the policy requires {name}"))
    return rows.withColumn("reason", reason)


def policies(rows: DataFrame, modes: list[tuple[bool, str, str]]) -> DataFrame:
    """rows(finalized, healthy, status) under each of modes (finalized_only, time_quality, coverage), in one scan.

    Reasons are those of ``policy``; what a require mode finds is ``stops:`` and its name, and stops nothing here.
    """
    wanted = F.array(*[F.struct(F.lit(f).alias("finalized_only"), F.lit(t).alias("time_quality"), F.lit(c).alias("coverage")) for f, t, c in modes])
    rows = rows.withColumn("_mode", F.explode(wanted)).select(*rows.columns, "_mode.*")
    reason = F.when(F.col("finalized_only") & ~F.col("finalized"), "not-finalized")
    for mode, bad, name in (("time_quality", ~F.col("healthy"), "time-quality"), ("coverage", F.col("status") != "complete", "coverage")):
        reason = reason.when((F.col(mode) == "exclude") & bad, name).when((F.col(mode) == "require") & bad, f"stops:{name}")
    return rows.withColumn("reason", reason)


def violations(rows: DataFrame, keys: list[str], interval: int = HOUR_NS) -> DataFrame:
    """How many rows of the dataset form break each rule, in one pass; a row may break several.

    Prices are decimal text that fits decimal(38, 18), labels come with their end or not at all.
    """
    price = lambda c: F.col(c).try_cast("decimal(38,18)")
    sane = (price("low") >= 0) & (price("low") <= F.least(price("open"), price("close"))) & (F.greatest(price("open"), price("close")) <= price("high"))
    rules = {
        "bad_hash": ~is_digest(F.col("raw_sha256")), "bad_grid": (F.pmod("start_ns", F.lit(interval)) != 0) | (F.col("interval_ns") != interval), "bad_prices": fits_decimal(F.col("close")) & ~F.coalesce(sane, F.lit(False)),
        "bad_unit": ~F.coalesce(F.col("volume_unit").rlike("^[a-z0-9]+$"), F.lit(False)), "bad_decimal": ~fits_decimal(F.col("close")), "bad_label": F.col("label_close").isNull() != F.col("label_end_ns").isNull(),
    }
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def sorted_struct(value: Column, type_) -> Column:
    """The struct with its field names ascending at every level."""
    if type_.typeName() == "struct":
        return F.struct(*[sorted_struct(value[f.name], f.dataType).alias(f.name) for f in sorted(type_.fields, key=lambda f: f.name)])
    if type_.typeName() == "array":
        return F.transform(value, lambda x: sorted_struct(x, type_.elementType))
    return F.lower(F.hex(value)) if type_.typeName() == "binary" else value


def canonical_json(value: Column, rows: DataFrame) -> Column:
    r"""JSON text of a nested value of ``rows``: sorted names, nulls kept, binary as hex, \\u escapes beyond ASCII."""
    type_ = rows.select(value.alias("v")).schema["v"].dataType
    text = F.to_json(sorted_struct(value, type_), {"ignoreNullFields": "false"})
    units = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")).otherwise(c))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(units, "")).otherwise(text)


def forecast_checks(rows: DataFrame, keys: list[str], first: Column, horizon: int, step: int) -> DataFrame:
    """rows(keys, start_ns, q10, q50, q90): the first rule that each forecast breaks: finite values, equally rising
    times, as many as the horizon, from the first time on, quantiles in order."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = rows.withColumn("_first", first).withColumn("_step", F.col("start_ns") - F.lag("start_ns").over(W.partitionBy(*keys).orderBy("start_ns")))
    good = finite("q10") & finite("q50") & finite("q90")
    out = rows.groupBy(*keys, "_first").agg(
        F.count_if(~F.coalesce(good, F.lit(False))).alias("_bad"), F.count_if(F.col("_step") != step).alias("_steps"), F.count("*").alias("_n"), F.min("start_ns").alias("_start"),
        F.count_if(~((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90")))).alias("_crossed"))
    state = F.when(F.col("_bad") > 0, "not-finite").when(F.col("_steps") > 0, "timestamps").when(F.col("_n") != horizon, "count").when(F.col("_start") != F.col("_first"), "first").when(F.col("_crossed") > 0, "quantile-order").otherwise("ok")
    return out.select(*keys, state.alias("state"))


def band_scores(rows: DataFrame, keys: list[str], quantiles: dict[str, float], bands: dict[str, tuple[str, str]]) -> DataFrame:
    """E5: pinball loss of each quantile column, coverage and width of each band, against ``target``."""
    t = F.col("target")
    pinball = [F.round(F.avg(F.greatest(q * (t - F.col(c)), (q - 1) * (t - F.col(c)))), 8).alias(f"pinball_{c[1:]}") for c, q in quantiles.items()]
    cover = [F.round(F.avg(t.between(F.col(a), F.col(b)).cast("double")), 8).alias(f"coverage_{n}") for n, (a, b) in bands.items()]
    width = [F.round(F.avg(F.col(b) - F.col(a)), 8).alias(f"width_{n}") for n, (a, b) in bands.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *pinball, *cover, *width)


def capacity(rows: DataFrame, keys: list[str], days: int, spare: float) -> DataFrame:
    """Records, bytes and rate of rows(keys, ns, logical, encoded), and the disk for ``days`` with a factor to spare."""
    span = (F.max("ns") - F.min("ns")) / F.lit(24.0 * HOUR_NS)
    out = rows.groupBy(*keys).agg(F.count("*").alias("records"), F.sum("logical").cast("bigint").alias("logical_bytes"), F.sum("encoded").cast("bigint").alias("encoded_bytes"), span.alias("_days"))
    gib = days * F.col("encoded_bytes") / F.col("_days") / 2.0**30
    return out.select(*keys, "records", "logical_bytes", "encoded_bytes", F.round(F.col("records") / F.col("_days"), 6).alias("records_a_day"), F.round(gib, 9).alias(f"gib_{days}_days"), F.round(spare * gib, 9).alias(f"disk_{days}_days"))


def fingerprint_chain(bars: DataFrame, ahead: int, interval: int) -> DataFrame:
    """one hash over the fingerprints (fp) of the label chain's bars in order, up to the first missing or open one."""
    rows, w = chained(bars, 0, ahead, interval, None)
    parts, on = [], F.lit(True)
    for k in range(1, ahead + 1):
        on = on & F.coalesce(F.lead("start_ns", k).over(w) == F.col("start_ns") + k * interval, F.lit(False))
        parts.append(F.when(on, F.lead("fp", k).over(w)))
        on = on & F.coalesce(F.lead("finalized", k).over(w), F.lit(False))
    return rows.select("series", "start_ns", "_own", F.sha2(F.concat_ws(",", *parts), 256).alias("lineage_sha256")).where("_own").drop("_own")


def dependence(daily: DataFrame, most: int) -> DataFrame:
    """daily(series, day, r, a) to series, lag, acf of r and a, and the span behind the last lag beyond 2 / sqrt(n)."""
    m = daily.groupBy("series").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "ra"], *[(F.count("*") * F.var_pop(c)).alias(f"v{c}") for c in "ra"])
    x = daily.join(m, "series").select("series", "day", "n", "vr", "va", (F.col("r") - F.col("mr")).alias("r"), (F.col("a") - F.col("ma")).alias("a"))
    y = x.select("series", F.col("day").alias("later"), F.col("r").alias("r2"), F.col("a").alias("a2"))
    near = x.withColumn("later", F.explode(F.sequence(F.col("day") + 1, F.col("day") + most)))  # days, not rows: small
    both = near.join(y, ["series", "later"]).withColumn("lag", F.col("later") - F.col("day"))
    out = both.groupBy("series", "lag", "n", "vr", "va").agg(*[(F.sum(F.col(c) * F.col(f"{c}2")) / F.col(f"v{c}")).alias(n) for c, n in (("r", "acf"), ("a", "acf_abs"))])
    strong = (F.abs("acf") > 2 / F.sqrt("n")) | (F.abs("acf_abs") > 2 / F.sqrt("n"))
    span = F.max(F.when(strong, F.col("lag"))).over(W.partitionBy("series")) + 1
    return out.select("series", "lag", F.round("acf", 6).alias("acf"), F.round("acf_abs", 6).alias("acf_abs"), span.alias("span"))


def page_after(chain: DataFrame, anchor: DataFrame, limit: int) -> DataFrame:
    """chain(series, offset, before): each series' ``limit`` rows behind its anchor and whether each follows the last."""
    w = W.partitionBy("series").orderBy("offset")
    rows = chain.join(anchor, "series").where(F.col("offset") > F.col("anchor")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    return rows.select("series", "offset", "before", (F.coalesce(F.lag("offset").over(w), F.col("anchor")) == F.col("before")).alias("continuous"))


def round_robin(rows: DataFrame, cursor: int, limit: int) -> DataFrame:
    """rows(series, pos, start_ns) by hour, series in turn from the one behind the cursor on; a top-``limit`` list."""
    top = rows.orderBy("start_ns", F.col("pos") <= cursor, "pos").limit(limit)
    return top.select("series", "start_ns", F.row_number().over(W.orderBy("start_ns", F.col("pos") <= cursor, "pos")).cast("bigint").alias("turn"))  # of the list only


def restarts(rows: DataFrame) -> DataFrame:
    """H9: rows(stream, session, ns, checkpoint): unknown from a session's last checkpoint (its first message without
    one) to the next session's first message; the last span stays open."""
    ends = rows.groupBy("stream", "session").agg(F.min("ns").alias("_first"), F.max(F.when(F.col("checkpoint"), F.col("ns"))).alias("_last"))
    end = F.lead("_first").over(W.partitionBy("stream").orderBy("_first", "session"))
    return ends.select("stream", "session", F.coalesce("_last", "_first").alias("gap_start"), end.alias("gap_end"), F.when(end.isNull(), "open").otherwise("closed").alias("state"))


def pipeline_lag(stages: dict[str, DataFrame], now_ns: int, limit_ns: int) -> DataFrame:
    """Per series the age of the last message received, counts of each stage and what lies between first and last."""
    names = list(stages)
    counts = [df.groupBy("series").agg(F.count("*").alias(n), *([F.max("ns").alias("last_ns")] if n == names[0] else [])) for n, df in stages.items()]
    out = reduce(lambda a, b: a.join(b, "series", "left"), counts).na.fill(0, names)
    age = F.lit(now_ns) - F.col("last_ns")
    return out.select("series", "last_ns", age.alias("age_ns"), (age > limit_ns).alias("stale"), *names, (F.col(names[0]) - F.col(names[-1])).alias("lag"))


def known_origins(bars: DataFrame, lookback: int, delay_ns: int, span: int | None = None) -> DataFrame:
    """bars(series, start_ns, finalized, known_ns): eligibility of each grid hour's end from its whole lookback as known
    ``delay_ns`` behind it; reason is the first failing hour's: missing, not-final or not-yet-known.

    Missing and open hours come from the running next fault. An hour known late spoils only the origins until it is known, so
    it is spread over as many hours as it is late, at most the lookback.
    """
    rows = next_faults(bars.withColumn("close", F.lit(None)), span)
    first = rows.select("series", (F.col("start_ns") + (lookback - 1) * HOUR_NS).alias("start_ns"), "fault")
    own = F.col("start_ns") + HOUR_NS + delay_ns
    late = bars.where(F.col("finalized") & (F.col("known_ns") > own))
    until = F.col("start_ns") + F.least(F.expr(f"(known_ns - start_ns - {HOUR_NS + delay_ns} - 1) div {HOUR_NS}"), F.lit(lookback - 1)) * HOUR_NS
    spoiled = late.select("series", "start_ns", F.explode(F.sequence("start_ns", until, F.lit(HOUR_NS))).alias("last_ns"))
    spoiled = spoiled.groupBy("series", F.col("last_ns").alias("start_ns")).agg(F.min("start_ns").alias("_late"))
    out = rows.drop("fault").join(first, ["series", "start_ns"], "left").join(spoiled, ["series", "start_ns"], "left")
    known = F.when(F.col("fault.start_ns") <= F.col("start_ns"), F.col("fault"))
    reason = F.when(F.col("start_ns") - (lookback - 1) * HOUR_NS < F.col("lo"), "missing-history-boundary").when(F.col("_late") < F.coalesce(known["start_ns"], F.lit(2**62)), "not-yet-known").otherwise(known["bad"])
    return out.select("series", (F.col("start_ns") + HOUR_NS).alias("origin_ns"), reason.alias("reason"))
