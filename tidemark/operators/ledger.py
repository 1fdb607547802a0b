"""The forecast ledger and lineage (C10 to C12, K1 to K11, L1 to L10), over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import DAY_NS, HOUR_NS


def slots(instruments: DataFrame, start_ns: int, end_ns: int, horizons: list[int]) -> DataFrame:
    """A slot for each instrument, hour and horizon; horizons of a day or more only on the UTC day grid."""
    grid = instruments.select("series", F.explode(F.sequence(F.lit(start_ns), F.lit(end_ns - HOUR_NS), F.lit(HOUR_NS))).alias("origin_ns"))
    grid = grid.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return grid.where((F.col("horizon") < 24) | (F.pmod("origin_ns", F.lit(DAY_NS)) == 0))


def published(events: DataFrame) -> DataFrame:
    """K2, C11: published, repeat or conflict for each (slot, sequence, content): the first content of a slot wins."""
    w = W.partitionBy("slot").orderBy("sequence")
    first = F.first("content").over(w)
    return events.withColumn("outcome", F.when(F.row_number().over(w) == 1, "published").when(F.col("content") == first, "repeat").otherwise("conflict"))


def missed(due: DataFrame, done: DataFrame, keys: list[str], now_ns: int, grace_ns: int) -> DataFrame:
    """Slots without a publication: missed once their grace is over, else missing."""
    rows = due.join(done.select(*keys).distinct(), keys, "left_anti")
    return rows.withColumn("state", F.when(F.col("origin_ns") + grace_ns < now_ns, "missed").otherwise("missing"))


def vintages(outcomes: DataFrame) -> DataFrame:
    """K6: (slot, as_of, version): a vintage where the version differs from the one before, with what it supersedes."""
    w = W.partitionBy("slot").orderBy("as_of")
    rows = outcomes.withColumn("supersedes", F.lag("version").over(w))
    rows = rows.where(F.col("supersedes").isNull() | (F.col("version") != F.col("supersedes")))
    return rows.withColumn("vintage", F.row_number().over(w))


def score_view(scores: DataFrame, as_of: int, first_available: bool) -> DataFrame:
    """K8: one score a slot as seen at ``as_of``."""
    pick = F.min_by if first_available else F.max_by
    rest = [c for c in scores.columns if c != "slot"]
    return scores.where(F.col("as_of") <= as_of).groupBy("slot").agg(pick(F.struct(*rest), "as_of").alias("s")).select("slot", "s.*")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """MAE difference of two streams over the truths both scored, by horizon and over all (null)."""
    both = left.select("truth", "horizon", F.col("abs_error").alias("l")).join(right.select("truth", F.col("abs_error").alias("r")), "truth")
    out = both.rollup("horizon").agg(F.count("*").alias("n"), F.round(F.avg("l") - F.avg("r"), 8).alias("mae_difference"))
    return out


def digest(rows: DataFrame, keys: list[str], order: list[str], fields: list[Column]) -> DataFrame:
    """An ordered digest of each group: the hash of its rows' hashes in order."""
    one = rows.select(*keys, *order, F.sha2(F.concat_ws("|", *fields), 256).alias("_h"))
    listed = F.array_sort(F.collect_list(F.struct(*order, "_h")))
    return one.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["_h"]), ""), 256).alias("digest"))


def chained(manifests: DataFrame) -> DataFrame:
    """L3: (producer, sequence, digest) with the hash of the manifest before it; a fold over each producer's manifests only."""
    zero = F.struct(F.lit("0" * 64).alias("last"), F.array().cast("array<struct<sequence:int,previous:string,own:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = F.sha2(F.concat_ws("|", x["sequence"].cast("string"), x["digest"], a["last"]), 256)
        return F.struct(own.alias("last"), F.concat(a["out"], F.array(F.struct(x["sequence"].alias("sequence"), a["last"].alias("previous"), own.alias("own")))).alias("out"))

    out = manifests.groupBy("producer").agg(F.aggregate(F.array_sort(F.collect_list(F.struct(F.col("sequence").cast("int").alias("sequence"), "digest"))), zero, step)["out"].alias("chain"))
    return out.select("producer", F.explode("chain").alias("c")).select("producer", "c.*")


def chain_breaks(chain: DataFrame) -> DataFrame:
    """Rows whose previous hash or sequence does not follow from the row before."""
    w = W.partitionBy("producer").orderBy("sequence")
    bad = (F.col("previous") != F.coalesce(F.lag("own").over(w), F.lit("0" * 64))) | (F.col("sequence") != F.coalesce(F.lag("sequence").over(w) + 1, F.lit(1)))
    return chain.withColumn("broken", bad).where("broken").select("producer", "sequence")


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other."""
    return one.exceptAll(two).withColumn("side", F.lit("left")).union(two.exceptAll(one).withColumn("side", F.lit("right")))
