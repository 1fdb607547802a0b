"""Stateful and micro-batch streams (A7, D2, H10, H11): state a key, appended results, restarts go on from checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.expressions import HOUR_NS
from tidemark.sources.scratch import fresh


def classified(obs: DataFrame) -> DataFrame:
    """obs(series, start_ns, offset, revision, finalized) to kinds, by a candle's state: its revisions so far and
    whether one was final. Within a micro-batch rows go by offset; the state of a candle is as large as its revisions."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, final = state.get if state.exists else ("", False)
        known = set(seen.split()) if seen else set()
        rows = pd.concat(list(batches)).sort_values("offset")
        kinds = []
        for revision, finalized in zip(rows["revision"], rows["finalized"], strict=True):
            kinds.append("duplicate" if revision in known else "accepted" if not known else "conflict" if final else "finalization" if finalized else "open_revision")
            known.add(revision)
            final = final or bool(finalized)
        state.update((" ".join(sorted(known)), final))
        yield pd.DataFrame({"series": key[0], "start_ns": key[1], "offset": rows["offset"].to_numpy(), "kind": kinds})

    out = "series string, start_ns bigint, offset bigint, kind string"
    return obs.groupBy("series", "start_ns").applyInPandasWithState(step, out, "seen string, final boolean", "append", GroupStateTimeout.NoTimeout)


def sequence_gaps(rows: DataFrame) -> DataFrame:
    """rows(stream, offset, seq, snapshot) by stream: gaps in the sequence, rows that came behind it (late, for a side
    table) and losses of the book, which is valid from a snapshot until the next number is missing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, valid = state.get if state.exists else (-1, False)
        out = []
        for offset, seq, snapshot in pd.concat(list(batches)).sort_values("offset")[["offset", "seq", "snapshot"]].itertuples(index=False):
            if snapshot:
                valid, high = True, seq
                continue
            if high >= 0 and seq <= high:
                out.append((key[0], "late", seq, seq, offset))
                continue
            if high >= 0 and seq > high + 1:
                out.append((key[0], "gap", high + 1, seq - 1, offset))
                if valid:
                    out.append((key[0], "book-loss", seq, seq, offset))
                valid = False
            high = seq
        state.update((int(high), bool(valid)))
        yield pd.DataFrame(out, columns=["stream", "kind", "first_seq", "last_seq", "offset"])

    out = "stream bigint, kind string, first_seq bigint, last_seq bigint, offset bigint"
    return rows.groupBy("stream").applyInPandasWithState(step, out, "high bigint, valid boolean", "append", GroupStateTimeout.NoTimeout)


def published(stream: DataFrame, transform, label: str) -> DataFrame:
    """Each micro-batch transformed and written below its own number, which a repeated batch overwrites: once in effect.

    A batch may be one file of one row group, so its rows are dealt over all cores before the transformation.
    """
    spark = stream.sparkSession
    home, tasks = fresh(spark, label), 2 * spark.sparkContext.defaultParallelism

    def publish(batch: DataFrame, number: int) -> None:
        transform(batch.repartition(tasks)).write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/rows")


KLINES = "topic string, ts bigint, data array<struct<start:bigint,end:bigint,interval:string,open:string,close:string,high:string,low:string,volume:string,confirm:boolean,timestamp:bigint>>"


def kline_envelopes(messages: DataFrame) -> DataFrame:
    """Messages of a topic with 1 to 8 candles to a row each: state is bad-batch, bad-boundary (the end must be the
    last millisecond of the interval), or accepted; final only if the source confirms and its clock has passed the close."""
    rows = messages.withColumn("n", F.size("data")).select("topic", "ts", "n", F.explode("data").alias("k")).select("topic", "ts", "n", "k.*")
    end = F.col("start") + HOUR_NS // 1_000_000 - 1
    state = F.when(~F.col("n").between(1, 8), "bad-batch").when((F.col("end") != end) | (F.col("interval") != "60"), "bad-boundary").otherwise("accepted")
    return rows.select(F.element_at(F.split("topic", r"\."), 3).alias("symbol"), F.col("start").alias("start_ms"), "close", state.alias("state"), (F.col("confirm") & (F.col("timestamp") > F.col("end"))).alias("finalized"))


def kline_stream(spark: SparkSession, folder: str) -> DataFrame:
    return kline_envelopes(spark.readStream.schema(KLINES).option("maxFilesPerTrigger", 4).json(folder))
