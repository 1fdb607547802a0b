"""Forecast ledger: receipts, states, cohorts, comparison, inspection, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import chains
from tidemark.operators.scan import BLOCK_OFFSETS, prefix
from tidemark.sources.scratch import durable

#: Evidence classes that a stream may declare, fixed names.
FORWARD, SYNTHETIC = "forward-shadow", "synthetic-fixture"


def receipts(publications: DataFrame, inputs: DataFrame, certificates: DataFrame) -> DataFrame:
    """K3: publications(slot, declared, timeliness, input_id, latest_available_ns, origin_ns, instrument, reference, close)
    with evidence_class.

    Only forward streams are classified: late is late-forward; genuine-forward needs an on-time publication, one
    input of the same origin, instrument, reference and close, and one on-time certificate of it; anything else is
    forward-unclassified.
    """
    one = inputs.groupBy("input_id").agg(F.count("*").alias("_n"), F.first(F.struct("origin_ns", "instrument", "reference", "close")).alias("_input"))
    good = certificates.where("timeliness = 'on-time'").groupBy("input_id", "latest_available_ns").agg(F.count("*").alias("_certificates"))
    rows = publications.join(one, "input_id", "left").join(good, ["input_id", "latest_available_ns"], "left")
    same = F.coalesce(F.col("_input").eqNullSafe(F.struct("origin_ns", "instrument", "reference", "close")), F.lit(False))
    forward = F.when(F.col("timeliness") == "late", "late-forward").when((F.col("timeliness") == "on-time") & F.coalesce(F.col("_n") == 1, F.lit(False)) & F.coalesce(F.col("_certificates") == 1, F.lit(False)) & same, "genuine-forward").otherwise("forward-unclassified")
    return rows.withColumn("evidence_class", F.when(F.col("declared") == FORWARD, forward).otherwise(F.col("declared"))).drop("_n", "_input", "_certificates")


def pre_score_state(final_start_ns: int, as_of_ns: int, delay_ns: int) -> Column:
    """K5: struct(state, reason) of a publication before it is scored, null if it may be: sealed, excluded, abstained, pending, in this order."""
    pair = lambda s, r: F.struct(F.lit(s).alias("state"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    return (
        F.when((F.col("declared") == FORWARD) & (F.col("endpoint_ns") >= final_start_ns), pair("sealed", "final-outcome-access-denied"))
        .when((F.col("declared") == FORWARD) & (F.col("evidence_class") != "genuine-forward"), pair("excluded", F.col("evidence_class")))
        .when((F.col("declared") == SYNTHETIC) & (F.col("timeliness") != "on-time"), pair("excluded", F.concat(F.lit("publication-"), F.col("timeliness"))))
        .when(F.col("point").isNull(), pair("abstained", F.coalesce("why", F.lit("abstained"))))
        .when(F.lit(as_of_ns) < F.col("endpoint_ns") + delay_ns, pair("pending", "not-mature"))
    )


def cohort(marks: DataFrame, publications: DataFrame, scores: DataFrame, as_of_ns: int) -> DataFrame:
    """K9: one row a slot at an as-of: marks(slot, state, reason, as_of_ns), publications with committed_ns (null: not
    observed), scores(slot, truth, as_of_ns, abs_error) in vintages; the latest score seen counts.

    A score makes it scored, no point abstained, else pending; an earlier mark stands while there is no score; a late or
    unclear publication of a checked stream overrules both, the forward class last.
    """
    latest = marks.where(F.col("as_of_ns") <= as_of_ns).groupBy("slot").agg(F.max_by(F.struct("state", "reason", "as_of_ns"), "as_of_ns").alias("mark"))
    seen = scores.where(F.col("as_of_ns") <= as_of_ns).groupBy("slot").agg(F.max_by(F.struct("truth", "abs_error"), "as_of_ns").alias("score"), F.min_by(F.struct("truth", "abs_error"), "as_of_ns").alias("first_score"))
    done = publications.where(F.col("committed_ns") <= as_of_ns)
    rows = latest.join(done, "slot", "full_outer").join(seen, "slot", "left")
    published = F.col("declared").isNotNull()
    scored = F.col("score").isNotNull() & published
    state = F.when(scored, "scored").when(F.col("mark").isNotNull(), F.col("mark.state")).when(F.col("point").isNull(), "abstained").otherwise("pending")
    reason = F.when(scored | F.col("mark").isNull(), F.col("why")).otherwise(F.col("mark.reason"))
    checked = F.coalesce(F.col("declared").isin(FORWARD, SYNTHETIC) & (F.col("timeliness") != "on-time"), F.lit(False))
    unclear = F.coalesce((F.col("declared") == FORWARD) & (F.col("evidence_class") != "genuine-forward"), F.lit(False))
    state = F.when(unclear, F.when(F.col("evidence_class") == "late-forward", "late").otherwise("unclassifiable")).when(checked, F.when(F.col("timeliness") == "late", "late").otherwise("unclassifiable")).otherwise(state)
    reason = F.when(unclear, F.col("evidence_class")).when(checked, F.col("timeliness")).otherwise(reason)
    out = rows.withColumn("state", state).withColumn("reason", reason).withColumn("seen_ns", F.greatest("committed_ns", "mark.as_of_ns"))
    return out.drop("mark")


def compared(rows: DataFrame, left: str, right: str) -> DataFrame:
    """A cohort's two streams over the truths both scored: pairs and difference of mean errors by horizon and over all (null)."""
    scored = rows.where("state = 'scored'").select("stream", "horizon", F.col("score.truth").alias("truth"), F.col("score.abs_error").alias("e"))
    both = scored.where(F.col("stream") == left).select("truth", "horizon", F.col("e").alias("l")).join(scored.where(F.col("stream") == right).select("truth", F.col("e").alias("r")), "truth")
    return both.rollup("horizon").agg(F.count("*").alias("paired"), F.round(F.avg("l") - F.avg("r"), 8).alias("mae_difference"))


def cohort_counts(rows: DataFrame) -> DataFrame:
    """A cohort's states by stream, and by stream, horizon and instrument, in one pass."""
    by = rows.groupingSets([[F.col("stream"), F.col("state")], [F.col("stream"), F.col("horizon"), F.col("instrument"), F.col("state")]], F.col("stream"), F.col("horizon"), F.col("instrument"), F.col("state"))
    return by.agg(F.count("*").alias("n")).select("stream", "horizon", "instrument", "state", "n")


def cached_origins(inputs: DataFrame, observations: DataFrame, certificates: DataFrame) -> DataFrame:
    """Per (instrument, origin_ns) the latest marker, an input or an observation of one, if exactly one certificate
    names it and its clock is qualified. Sequences are unique over both tables."""
    first = inputs.select("instrument", "origin_ns", "sequence", "input_id", F.lit("").alias("observation_id"))
    later = observations.join(inputs.select("input_id", "instrument", "origin_ns"), "input_id").select("instrument", "origin_ns", "sequence", "input_id", "observation_id")
    last = first.unionByName(later).groupBy("instrument", "origin_ns").agg(F.max_by(F.struct("input_id", "observation_id"), "sequence").alias("x")).select("instrument", "origin_ns", "x.*")
    proof = certificates.groupBy("input_id", F.coalesce("observation_id", F.lit("")).alias("observation_id")).agg(F.count("*").alias("_n"), F.bool_and("clock_qualified").alias("_good"))
    return last.join(proof, ["input_id", "observation_id"], "left").where("_n = 1 and _good").drop("_n", "_good")


def inspected(rows: DataFrame, delay_ns: int, offset: int, limit: int) -> DataFrame:
    """A page of a cohort in order of slots, with deadline, expected maturity, first and revised score."""
    page = rows.orderBy("slot").offset(offset).limit(limit)
    return page.select(
        "slot", "stream", "instrument", "horizon", F.coalesce("evidence_class", "declared").alias("evidence_class"), "timeliness", (F.col("origin_ns") + delay_ns).alias("deadline_ns"), "state", "reason",
        (F.col("endpoint_ns") + delay_ns).alias("expected_maturity_ns"), F.col("first_score.abs_error").alias("first_error"), F.col("score.abs_error").alias("revised_error"))


def chain_faults(events: DataFrame, own: Column) -> DataFrame:
    """events(log, sequence, previous, sha, ...): faults of each row: its own hash, the link to the row before, a gap
    in the sequence. ``own`` is the hash recomputed from the row's body."""
    w = W.partitionBy("log").orderBy("sequence")
    fault = (
        F.when(F.col("sequence") != F.coalesce(F.lag("sequence").over(w) + 1, F.lit(1)), "sequence")
        .when(F.col("previous") != F.coalesce(F.lag("sha").over(w), F.lit("0" * 64)), "previous").when(F.col("sha") != own, "body")
    )
    return events.withColumn("fault", fault)


def continuity(manifests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """L4: manifests(producer, epoch, sequence, previous, own, first_offset, last_offset) against themselves, their epoch
    and checkpoints(producer, epoch, offset): level of the first fault: self, epoch, global, or null."""
    w = W.partitionBy("producer", "epoch").orderBy("sequence")
    rows = manifests.join(checkpoints.withColumnRenamed("offset", "_at"), ["producer", "epoch"], "left")
    last = F.max("sequence").over(W.partitionBy("producer", "epoch"))
    level = (
        F.when((F.col("first_offset") > F.col("last_offset")) | ~F.col("own").rlike("^[0-9a-f]{64}$"), "self")
        .when((F.col("previous") != F.coalesce(F.lag("own").over(w), F.lit("0" * 64))) | (F.col("sequence") != F.coalesce(F.lag("sequence").over(w) + 1, F.lit(1))) | (F.col("first_offset") <= F.coalesce(F.lag("last_offset").over(w), F.lit(-1))), "epoch")
        .when((F.col("sequence") == last) & ~F.col("last_offset").eqNullSafe(F.col("_at")), "global")
    )
    return rows.withColumn("level", level).drop("_at")


def retention_roots(snapshots: DataFrame) -> DataFrame:
    """snapshots(snapshot, parquet_sha256, inputs: array of (manifest, objects)) to distinct (snapshot, kind, root)."""
    rows = snapshots.select("snapshot", "parquet_sha256", F.explode_outer("inputs").alias("i"))
    one = rows.select("snapshot", F.lit("object").alias("kind"), F.col("parquet_sha256").alias("root"))
    two = rows.select("snapshot", F.lit("manifest").alias("kind"), F.col("i.manifest").alias("root"))
    three = rows.select("snapshot", F.lit("object").alias("kind"), F.explode("i.objects").alias("root"))
    return one.union(two).union(three).where("root is not null").distinct()


def trials(events: DataFrame, most: int = 8) -> DataFrame:
    """events(trial, sequence, config, phase, attempt) with ``outcome``: appended, repeat, identity-conflict,
    not-registered or budget-exhausted.

    A trial exists from its first registration that the budget lets in, which fixes its configuration. A budget is
    the ``most`` first events of the phase that would be appended.
    """
    born = events.where("phase = 'registered'").groupBy("trial").agg(F.min_by(F.struct("sequence", "config"), "sequence").alias("b"))
    allowed = born.orderBy("b.sequence").limit(most)  # the budget: a few rows
    rows = events.join(F.broadcast(allowed), "trial", "left")
    since = F.coalesce(F.col("sequence") >= F.col("b.sequence"), F.lit(False))
    wrong = since & (F.col("config") != F.col("b.config"))
    again = F.row_number().over(W.partitionBy("trial", since & ~wrong, "config", "phase", "attempt").orderBy("sequence")) > 1
    state = F.when(wrong, "identity-conflict").when(since & again, "repeat").when(since, "due").when(F.col("phase") == "registered", "budget-exhausted").otherwise("not-registered")
    rows = rows.withColumn("outcome", state)
    fits = [rows.where((F.col("outcome") == "due") & (F.col("phase") == p)).orderBy("sequence").limit(most).select("sequence") for p in ("registered", "started")]
    rows = rows.join(F.broadcast(fits[0].union(fits[1]).withColumn("_fits", F.lit(True))), "sequence", "left")  # two budgets
    over = (F.col("outcome") == "due") & F.col("phase").isin("registered", "started") & F.col("_fits").isNull()
    return rows.withColumn("outcome", F.when(over, "budget-exhausted").when(F.col("outcome") == "due", "appended").otherwise(F.col("outcome"))).drop("b", "_fits")


def loss_status(losses: DataFrame) -> DataFrame:
    """H4: losses(family, recovery, end_ns, ...) with status: a closed candle gap with backfill is pending, trades,
    liquidations and books are unrecoverable, all else is unknown."""
    status = F.when((F.col("family") == "candle") & (F.col("recovery") == "backfill") & F.col("end_ns").isNotNull(), "pending").when(F.col("family").isin("trade", "liquidation", "book"), "unrecoverable").otherwise("unknown")
    return losses.withColumn("status", status)


def clock_epochs(samples: DataFrame, max_step_ns: int, max_gap_ns: int) -> DataFrame:
    """samples(clock, order, session, wall_ns, mono_ns, boot_ns or null, unc_ns, status) with disruption and epoch.

    A change of session, a monotonic clock that runs back, time that passed in suspension, a step of the wall clock and a
    pause in sampling are told apart in this order; every disruption and every change of status opens an epoch.
    """
    w = W.partitionBy("clock").orderBy("order")
    step = {c: F.col(c) - F.lag(c).over(w) for c in ("wall_ns", "mono_ns", "boot_ns")}
    allowed = max_step_ns + F.col("unc_ns") + F.lag("unc_ns").over(w)
    kind = (
        F.when(F.lag("session").over(w) != F.col("session"), "session_changed").when((step["mono_ns"] < 0) | (step["boot_ns"] < 0), "monotonic_regression")
        .when(F.abs(step["boot_ns"] - step["mono_ns"]) > allowed, "suspend").when(F.abs(step["wall_ns"] - step["mono_ns"]) > allowed, "clock_step").when(step["mono_ns"] > max_gap_ns, "sampling_gap")
    )
    rows = samples.withColumn("disruption", kind)
    opens = F.col("disruption").isNotNull() | F.coalesce(F.col("status") != F.lag("status").over(w), F.lit(True))
    return rows.withColumn("epoch", F.sum(opens.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def byte_batches(rows: DataFrame, keys: list[str], most_records: int, most_bytes: int, span: int = BLOCK_OFFSETS) -> DataFrame:
    """rows(keys, offset, n_bytes) in order with ``batch``: as many as fit into both limits; a larger row stands alone.

    A batch ends before the first row whose running size exceeds that before the batch by more than the limit. Starts of batches
    are a greedy chain over these successors, so a group of any length is dealt over all tasks.
    """
    rows = prefix(rows, keys, "offset", span, {"_at": (F.sum, F.lit(1).cast("bigint")), "_size": (F.sum, F.col("n_bytes").cast("bigint"))})
    rows = durable(rows, "batch-rows")
    limit = rows.withColumn("_target", F.col("_size") - F.col("n_bytes") + most_bytes + 1)
    # sizes rise with the place, so blocks of sizes hold as many rows as blocks of places do on average
    by_size = chains.next_at_or_after(limit, keys, "_size", "_target", max(1, most_bytes) * 4096, "_at").withColumnRenamed("next", "_full")
    last = rows.groupBy(*keys).agg(F.max("_at").alias("_last"))
    next_ = F.greatest(F.col("_at") + 1, F.least(F.coalesce("_full", F.col("_last") + 1), F.col("_at") + most_records))
    links = by_size.join(last, keys).select(*keys, F.col("_at").alias("at"), F.when(next_ <= F.col("_last"), next_).alias("next"))
    starts = chains.taken(links, keys).select(*keys, F.col("at").alias("_at"), F.lit(1).alias("_opens"))
    out = prefix(rows.join(starts, [*keys, "_at"], "left"), keys, "_at", span, {"_batch": (F.sum, F.coalesce("_opens", F.lit(0)))})
    return out.select(*keys, "offset", (F.col("_batch") - 1).cast("int").alias("batch"))
