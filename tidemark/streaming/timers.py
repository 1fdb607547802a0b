"""Streams whose state ends (D2, H10, H13): map and value state a key, event-time timers, late rows told apart.

The event time stays outside the operator (``at_ms``, a plain number), so no row is dropped before it: what the watermark has
passed comes out as ``late``, for a sink of its own. A timer that fires clears its key's state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.expressions import HOUR_NS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1_000_000


@contextmanager
def keyed_store(spark: SparkSession):
    """The store that map state and timers need, for streams started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Candles(StatefulProcessor):
    """D2 with an end: revisions of a candle in map state, dropped ``keep_ms`` after the candle's own end."""

    def __init__(self, interval_ns: int, keep_ms: int):
        self.interval_ns, self.keep_ms = interval_ns, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "revision string", "finalized boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("offset")
        end = (int(key[1]) + self.interval_ns) // MS + self.keep_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            kinds = ["late"] * len(rows)
        else:
            known = {k[0]: bool(v[0]) for k, v in self.seen.iterator()} if self.seen.exists() else {}
            if not known:
                self.handle.registerTimer(end)
            final, kinds, fresh = any(known.values()), [], {}
            for revision, finalized in zip(rows["revision"], rows["finalized"], strict=True):
                kinds.append("duplicate" if revision in known else "accepted" if not known else "conflict" if final else "finalization" if finalized else "open_revision")
                if revision not in known:
                    known[revision] = fresh[revision] = bool(finalized)
                final = final or bool(finalized)
            for revision, finalized in fresh.items():
                self.seen.updateValue((revision,), (finalized,))
        yield pd.DataFrame({"series": key[0], "start_ns": key[1], "offset": rows["offset"].to_numpy(), "kind": kinds, "revisions": pd.array([None] * len(rows), "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = sum(1 for _ in self.seen.keys()) if self.seen.exists() else 0
        self.seen.clear()
        yield pd.DataFrame({"series": [key[0]], "start_ns": [key[1]], "offset": pd.array([None], "Int64"), "kind": ["closed"], "revisions": pd.array([n], "Int64")})

    def close(self) -> None:
        pass


def classified(obs: DataFrame, interval_ns: int = HOUR_NS, keep_ms: int = 3_600_000) -> DataFrame:
    """obs(series, start_ns, offset, revision, finalized, ts with a watermark) to kinds.

    Beside the kinds of the batch there are ``late`` (the candle was closed before) and ``closed`` (a row a candle when the
    watermark passes its end and ``keep_ms``, with its number of revisions; offset null). Rows go by offset in a micro-batch.
    """
    out = "series string, start_ns bigint, offset bigint, kind string, revisions bigint"
    rows = obs.select("series", "start_ns", "offset", "revision", "finalized")
    return rows.groupBy("series", "start_ns").transformWithStateInPandas(Candles(interval_ns, keep_ms), out, "Append", "EventTime")


class Sequences(StatefulProcessor):
    """The highest number, the book and the last time of a stream; a stream that is quiet too long goes stale."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("place", "high bigint, valid boolean, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("offset")
        high, valid, last = self.state.get() if self.state.exists() else (-1, False, -1)
        before, passed, out = last, timerValues.getCurrentWatermarkInMs(), []
        for offset, seq, snapshot, at in rows[["offset", "seq", "snapshot", "at_ms"]].itertuples(index=False):
            if at < passed:
                out.append(("late", seq, seq, offset))
                continue
            last = max(last, at)
            if snapshot:
                valid, high = True, seq
            elif high >= 0 and seq <= high:
                out.append(("late", seq, seq, offset))
            else:
                if high >= 0 and seq > high + 1:
                    out.append(("gap", high + 1, seq - 1, offset))
                    if valid:
                        out.append(("book-loss", seq, seq, offset))
                    valid = False
                high = seq
        if last >= 0:
            self.state.update((int(high), bool(valid), int(last)))
        if last > before:
            if before >= 0:
                self.handle.deleteTimer(int(before) + self.quiet_ms)
            self.handle.registerTimer(int(last) + self.quiet_ms)
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        high = self.state.get()[0] if self.state.exists() else -1
        self.state.clear()
        yield self.rows(key, [("stale", high, high, None)])

    def rows(self, key, out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["kind", "first_seq", "last_seq", "offset"]).astype({"first_seq": "int64", "last_seq": "int64", "offset": "Int64"})
        made.insert(0, "stream", key[0])
        return made

    def close(self) -> None:
        pass


def watched(rows: DataFrame, quiet_ms: int) -> DataFrame:
    """rows(stream, offset, seq, snapshot, ts with a watermark) to gap, book-loss, late and stale.

    Late are rows behind the watermark and rows behind a higher number of their stream. A stream is stale, once, when the
    watermark is ``quiet_ms`` past its last row; its state goes, and a later row starts it anew without a gap.
    """
    made = rows.select("stream", "offset", "seq", "snapshot", F.unix_millis("ts").alias("at_ms"))
    out = "stream string, kind string, first_seq bigint, last_seq bigint, offset bigint"
    return made.groupBy("stream").transformWithStateInPandas(Sequences(quiet_ms), out, "Append", "EventTime")


def split(stream: DataFrame, home: str, late: str = "kind = 'late'"):
    """Runs over all that has arrived: ``{home}/rows`` and, for late rows, ``{home}/late``, a folder a micro-batch, so a
    repeated batch overwrites itself. Started again on the same home it goes on from where it was. Returns the query."""

    def publish(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.where(f"not ({late})").write.mode("overwrite").parquet(f"{home}/rows/batch={number}")
        held.where(late).write.mode("overwrite").parquet(f"{home}/late/batch={number}")
        held.unpersist()

    with keyed_store(stream.sparkSession):
        run = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return run
