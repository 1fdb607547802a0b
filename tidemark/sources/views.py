"""The driver tables in the shapes of the market data model.

events is the tick feed: event_type names the instrument, value is the price, event_id the ingestion offset and
user_id the producer. A candle is final unless its number of ticks is a multiple of seven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR_NS, nanoseconds, semantic_revision


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, offset, producer, ns, price."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), F.col("event_id").alias("offset"), F.col("user_id").alias("producer"), nanoseconds(F.col("ts")).alias("ns"), F.col("value").alias("price"))


def candles(ticks: DataFrame, interval_ns: int = HOUR_NS) -> DataFrame:
    """Tumbling candles; open and close by (time, offset). One shuffle, partial aggregates before it."""
    start = F.col("ns") - F.pmod(F.col("ns"), F.lit(interval_ns))
    place = F.struct("ns", "offset")
    out = ticks.groupBy("series", start.alias("start_ns")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", place).alias("close"), F.count("*").alias("n"), F.min("offset").alias("offset"))
    return out.withColumn("finalized", F.col("n") % 7 != 0)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles(ticks(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message a tick: key (series, start_ns), coarse value, finality, revision; many repeats and revisions."""
    t = ticks(spark, sf_dir).withColumn("start_ns", F.col("ns") - F.pmod(F.col("ns"), F.lit(6 * HOUR_NS)))
    t = t.withColumn("price", F.floor(F.col("price") / 20) * 20).withColumn("finalized", F.pmod("offset", F.lit(9)) == 0)
    return t.withColumn("revision", semantic_revision(F.col("series"), F.col("start_ns"), F.col("price").cast("bigint"), F.col("finalized")))


TICKS_SQL = "ticks AS (SELECT event_type AS series, event_id AS off, user_id AS producer, epoch_us(ts) * 1000 AS ns, value AS price FROM events)"
BARS_SQL = TICKS_SQL + """,
bars AS (SELECT series, ns - ns % 3600000000000 AS start_ns, first(price ORDER BY ns, off) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ns, off) AS "close", count(*) AS n, min(off) AS off, count(*) % 7 <> 0 AS finalized FROM ticks GROUP BY 1, 2)"""
OBS_SQL = TICKS_SQL + """,
obs0 AS (SELECT series, off, producer, ns, ns - ns % 21600000000000 AS start_ns, CAST(floor(price / 20) * 20 AS BIGINT) AS price, off % 9 = 0 AS finalized FROM ticks),
obs AS (SELECT *, 'sha256:' || sha256('["' || series || '","' || start_ns || '","' || price || '","' || finalized || '"]') AS revision FROM obs0)"""
