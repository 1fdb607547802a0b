"""Classification and selection of candle observations (D1 to D10), set-based over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["series", "start_ns"]


def classified(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Kind of each observation in offset order. One shuffle by key serves both windows (revision is in the key's sort)."""
    past = W.partitionBy(*key).orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    again = F.row_number().over(W.partitionBy(*key, "revision").orderBy("offset")) > 1
    kind = (
        F.when(again, "duplicate").when(F.count("*").over(past) == 0, "accepted")
        .when(F.coalesce(F.bool_or("finalized").over(past), F.lit(False)), "conflict").when(F.col("finalized"), "finalization").otherwise("open_revision")
    )
    return obs.withColumn("kind", kind)


def barred(obs: DataFrame, blocked) -> DataFrame:
    """D3: rows at or behind a producer's first blocked offset are pending."""
    first = F.min(F.when(blocked, F.col("offset"))).over(W.partitionBy("producer"))
    return obs.withColumn("state", F.when(first.isNull() | (F.col("offset") < first), "processable").otherwise("pending"))


def linked(obs: DataFrame) -> DataFrame:
    """Predecessor of each offset within its producer."""
    return obs.withColumn("predecessor", F.lag("offset").over(W.partitionBy("producer").orderBy("offset")))


def selected(kinds: DataFrame, which: str = "latest", key: list[str] = KEY) -> DataFrame:
    """The latest or first revision that neither conflicts nor repeats, and the offsets that bear on it."""
    good = F.col("kind").isin("accepted", "open_revision", "finalization")
    pick = F.max_by if which == "latest" else F.min_by
    chosen = pick(F.struct("price", "finalized", "offset", "revision"), F.when(good, F.col("offset"))).alias("s")
    out = kinds.groupBy(*key).agg(chosen, F.array_sort(F.collect_list("offset")).alias("evidence"))
    return out.where("s is not null").select(*key, "s.*", F.size("evidence").alias("n_evidence"), F.concat_ws(",", F.transform("evidence", lambda x: x.cast("string"))).alias("evidence"))


def as_observed(obs: DataFrame, cutoff_ns: int, uncertainty_ns: int) -> tuple[DataFrame, DataFrame]:
    """(rows proven before the cutoff, exclusions)."""
    proven = F.coalesce(F.col("ns") + uncertainty_ns <= cutoff_ns, F.lit(False))
    return obs.where(proven), obs.where(~proven).withColumn("reason", F.lit("not_proven_before_cutoff"))


def violations(kinds: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Key, offset, reason of transitions that a dataset must not hold."""
    by = W.partitionBy(*key)
    several = F.min("producer").over(by) != F.max("producer").over(by)
    accepted = F.row_number().over(W.partitionBy(*key, "kind").orderBy("offset"))
    reason = F.when(F.col("kind") == "conflict", "conflict-input").when((F.col("kind") == "accepted") & (accepted > 1), "repeated-accepted").when(several & (F.col("kind") == "accepted"), "mixed-producer")
    return kinds.withColumn("reason", reason).where("reason is not null").select(*key, "offset", "reason")


def final_conflicts(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys with final observations of different content."""
    return obs.where("finalized").groupBy(*key).agg(F.count_distinct("revision").alias("n_revisions"), F.min("offset").alias("first_offset")).where("n_revisions > 1")


def risen(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Each row's predecessor by arrival within ``keys`` and whether its offset fails to rise above it."""
    before = F.lag("offset").over(W.partitionBy(*keys).orderBy(*arrival))
    return rows.withColumn("predecessor", before).withColumn("falls", F.col("offset") <= F.col("predecessor"))


def transitions(kinds: DataFrame, key: list[str] = KEY) -> DataFrame:
    """rows(key, offset, producer, finalized, kind) that break a rule, with the first it breaks: a conflict as input,
    accepted twice, a revision with nothing before it, a change behind a final one, several producers of one candle."""
    by = W.partitionBy(*key)
    order = by.orderBy("offset")
    several = F.min("producer").over(by) != F.max("producer").over(by)
    nth, place = F.row_number().over(W.partitionBy(*key, "kind").orderBy("offset")), F.row_number().over(order)
    done = F.coalesce(F.bool_or(F.col("finalized") & (F.col("kind") != "conflict")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    change = F.col("kind").isin("open_revision", "finalization")
    reason = (
        F.when(F.col("kind") == "conflict", "conflict-input").when((F.col("kind") == "accepted") & (nth > 1), "repeated-accepted").when(change & (place == 1), "no-predecessor")
        .when(change & done, "change-after-final").when(several & (place == 1), "mixed-producer")
    )
    return kinds.withColumn("reason", reason).where("reason is not null")
