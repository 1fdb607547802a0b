"""Streams over files of ticks: each runs all that has arrived, appends to Parquet in the shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR_NS, nanoseconds
from tidemark.sources.scratch import fresh


def tick_stream(spark: SparkSession, sf_dir: str, lateness: str = "1 hour") -> DataFrame:
    """events as a stream with a watermark on its event time: series, offset, producer, ns, price, ts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the file source lists folders and patterns; the pattern fits the one table
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    e = e.select(F.col("event_type").alias("series"), F.col("event_id").alias("offset"), F.col("user_id").alias("producer"), nanoseconds(F.col("ts")).alias("ns"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    return e.withWatermark("ts", lateness)


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Runs the stream over all files there are, then reads what it appended. Restarts go on from its checkpoint."""
    spark = stream.sparkSession
    home = fresh(spark, label)
    run = stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def deduplicated(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal rows within the watermark; state goes as it passes."""
    return ticks.dropDuplicatesWithinWatermark(keys)


def hourly(ticks: DataFrame) -> DataFrame:
    """Tumbling candles that are emitted when the watermark has passed their end."""
    place = F.struct("ns", "offset")
    by = ticks.groupBy(F.window("ts", "1 hour"), "series")
    out = by.agg(F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.count("*").alias("n"))
    start = F.unix_micros(F.col("window.start")) * 1000
    return out.select("series", start.alias("start_ns"), (start + HOUR_NS).alias("end_ns"), "open", "high", "low", "close", "n")
