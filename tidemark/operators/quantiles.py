"""Exact quantiles without a group in one task.

All ranks that are asked for are narrowed together: a pass counts the values of each open range by bins, the counts
tell in which bin a rank lies, and that bin's own least and greatest value are the next range. A range is done when it holds
one value, or few enough rows to be sorted. A pass moves a row a range and bin, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.scratch import durable

BINS = 512
#: Ranges up to this number are sent to all tasks (about 100 bytes each); more meet the rows in a join over salted keys.
MOST_SENT, SALTS = 100_000, 32


def _matched(rows: DataFrame, ranges: DataFrame, keys: list[str], sent: bool) -> DataFrame:
    """Each row with each range of its key that holds it."""
    inside = F.col("_v").between(F.col("lo"), F.col("hi"))
    if sent:
        return rows.join(F.broadcast(ranges), keys).where(inside)
    copies = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"]).where(inside).drop("_salt")


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column | str, at: dict[str, float], few: int = 50_000, bins: int = BINS) -> DataFrame:
    """keys and one column a quantile: linear interpolation at (n - 1) q, equal to the last bit to a sort of the whole group.

    Null values do not count; a group of nulls only has no row, as has an empty table. Values are finite.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = durable(rows.select(*keys, value.cast("double").alias("_v")).where("_v is not null"), "quantile-values")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    position = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("position")) for name, q in at.items()]))
    asked = groups.select("*", position.alias("p")).select(*keys, "n", "lo", "hi", "p.*")
    ranks = asked.select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))).alias("rank"))
    #: keys, rank, lo, hi, skipped (rows of the key below lo), n (rows within)
    open_ = durable(ranks.distinct().select(*keys, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("skipped"), "n"), "quantile-ranks")
    asked = durable(asked.select(*keys, "name", "position"), "quantile-asked")
    done = []
    while True:
        done.append(open_.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("_value")))
        ready = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        wide = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        here = [keys_ranges(x, keys) for x in (ready, wide)]
        counts = [x.count() for x in here]
        if counts[0]:
            met = _matched(rows, here[0], keys, counts[0] <= MOST_SENT)
            by = [*keys, "lo", "hi"]
            placed = met.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy("_v")) - 1)
            done.append(durable(placed.join(ready.select(*by, "rank", "skipped"), by).where(F.col("rank") - F.col("skipped") == F.col("_at")).select(*keys, "rank", F.col("_v").alias("_value")), "quantile-found"))
        if not counts[1]:
            break
        met = _matched(rows, here[1], keys, counts[1] <= MOST_SENT)
        # of a range that may overflow the halves are compared
        large = F.greatest(F.abs("lo"), F.abs("hi")) > 1e300
        share = F.when(large, (F.col("_v") / 2 - F.col("lo") / 2) / F.when(large, F.col("hi") / 2 - F.col("lo") / 2)).otherwise((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        bin_ = F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))
        histogram = met.groupBy(*keys, "lo", "hi", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = F.sum("_n").over(W.partitionBy(*keys, "lo", "hi").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
        histogram = histogram.withColumn("_below", F.coalesce(below, F.lit(0)))  # at most ``bins`` rows a range
        hit = (F.col("rank") - F.col("skipped") >= F.col("_below")) & (F.col("rank") - F.col("skipped") < F.col("_below") + F.col("_n"))
        nxt = wide.drop("n").join(histogram, [*keys, "lo", "hi"]).where(hit)
        open_ = durable(nxt.select(*keys, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("skipped") + F.col("_below")).alias("skipped"), F.col("_n").alias("n")), "quantile-ranks")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    found = durable(found, "quantile-values")
    both = asked
    for side, f in (("_low", F.floor), ("_high", F.ceil)):
        both = both.withColumn("rank", f("position")).join(found.withColumnRenamed("_value", side), [*keys, "rank"]).drop("rank")
    low, high, p = F.col("_low"), F.col("_high"), F.col("position")
    exact = F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in at])


def keys_ranges(open_: DataFrame, keys: list[str]) -> DataFrame:
    return open_.select(*keys, "lo", "hi").distinct()
