"""Streams that end their state, joins of streams, publication and the source with offsets. The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import CLAIMS, H, KIND_SQL, SPANS, claims_of, query, with_
from tidemark.functions.expressions import semantic_revision
from tidemark.operators import coverage
from tidemark.sources import publication
from tidemark.sources.offsets import OffsetArchive
from tidemark.sources.scratch import fresh
from tidemark.sources.views import BARS_SQL, OBS_SQL, TICKS_SQL, bars, ticks
from tidemark.streaming import joins, replay, timers

QUIET_MS = 3 * 86_400_000
#: The watermark, an hour behind the last tick, in ms.
PASSED = "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)"


@query(with_(OBS_SQL, KIND_SQL + f""" SELECT series, start_ns, off AS "offset", kind, CAST(NULL AS BIGINT) AS revisions FROM kinds
UNION ALL SELECT series, start_ns, NULL, 'closed', count(DISTINCT revision) FROM obs GROUP BY 1, 2 HAVING (start_ns + {7 * H}) // 1000000 <= {PASSED}"""))
def d2_stream_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """d2_stream_classify with state that ends: a candle closes an hour after its end, by a timer, and tells its revisions."""
    t = replay.tick_stream(spark, sf).withColumn("start_ns", F.col("ns") - F.pmod(F.col("ns"), F.lit(6 * H)))
    t = t.withColumn("price", F.floor(F.col("price") / 20) * 20).withColumn("finalized", F.pmod("offset", F.lit(9)) == 0)
    t = t.withColumn("revision", semantic_revision(F.col("series"), F.col("start_ns"), F.col("price").cast("bigint"), F.col("finalized")))
    with timers.keyed_store(spark):
        return replay.drained(timers.classified(t, 6 * H), "expiring")


@query(with_(TICKS_SQL, f""", r AS (SELECT producer AS stream, off, off % 10 = 0 AS snap, lag(off) OVER (PARTITION BY producer ORDER BY off) AS high, ns FROM ticks),
g AS (SELECT *, NOT snap AND off > high + 1 AS gap FROM r),
v AS (SELECT *, max(CASE WHEN snap THEN off END) OVER w > coalesce(max(CASE WHEN gap THEN off END) OVER w, -1) AS valid FROM g WINDOW w AS (PARTITION BY stream ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(stream AS VARCHAR) AS stream, 'gap' AS kind, high + 1 AS first_seq, off - 1 AS last_seq, off AS "offset" FROM v WHERE gap
UNION ALL SELECT CAST(stream AS VARCHAR), 'book-loss', off, off, off FROM v WHERE gap AND valid
UNION ALL SELECT CAST(producer AS VARCHAR), 'stale', max(off), max(off), NULL FROM ticks GROUP BY producer HAVING max(ns) // 1000000 + {QUIET_MS} <= {PASSED}"""))
def h10_h13_stream_watch(spark: SparkSession, sf: str) -> DataFrame:
    """Producers as streams of numbers: gaps, books lost (every tenth number is a snapshot), and who was quiet for three days."""
    t = replay.tick_stream(spark, sf).select(F.col("producer").cast("string").alias("stream"), "offset", F.col("offset").alias("seq"), (F.pmod("offset", F.lit(10)) == 0).alias("snapshot"), "ts")
    with timers.keyed_store(spark):
        return replay.drained(timers.watched(t, QUIET_MS), "watched")


@query(with_(BARS_SQL, f""", c AS ({CLAIMS}), s AS ({SPANS}),
o AS (SELECT s.*, c.claim_start, c.claim_end, c.status, claim_start > coalesce(max(claim_end) OVER (PARTITION BY s.series, span_start, span_end ORDER BY claim_start, claim_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), span_start) AS hole FROM s JOIN c ON s.series = c.series AND span_start < claim_end AND claim_start < span_end),
a AS (SELECT series, span_start, span_end, bool_or(hole) AS hole, max(claim_end) AS reach, bool_or(status = 'unrecoverable') AS u, bool_or(status = 'pending') AS p FROM o GROUP BY 1, 2, 3)
SELECT s.series, s.span_start, s.span_end, CASE WHEN u THEN 'unrecoverable' WHEN p THEN 'pending' WHEN NOT hole AND reach >= s.span_end THEN 'complete' ELSE 'unknown' END AS status FROM s LEFT JOIN a USING (series, span_start, span_end)"""))
def h5_stream_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Spans and claims arrive as two streams and are joined as they come; the pairs give the states of h5_coverage_status."""
    home, read = fresh(spark, "coverage"), {}
    for name, rows in zip(("spans", "claims"), claims_of(bars(spark, sf)), strict=True):
        rows.write.parquet(f"{home}/{name}")
        read[name] = spark.readStream.schema(rows.schema).parquet(f"{home}/{name}")
    both = replay.drained(joins.overlapping(read["spans"], read["claims"], ["series"], 2 * H, 5 * H), "covered")
    return coverage.status_of(spark.read.schema(read["spans"].schema).parquet(f"{home}/spans"), both.where("claim_start is not null"))


@query(with_(TICKS_SQL, " SELECT series, count(*) AS n, min(off) AS first, max(off) AS last, 'committed' AS one, 'already' AS again, 'conflict' AS other FROM ticks GROUP BY series"))
def a2_atomic_publication(spark: SparkSession, sf: str) -> DataFrame:
    """Four writers of one segment: one dies behind its intent and rows, one commits, one has the same rows, one other ones."""
    rows, home = ticks(spark, sf), fresh(spark, "segments")
    publication.staged(rows, home, "ticks")
    one, again, other = [publication.publish(r, home, "ticks") for r in (rows, rows.repartition(3, "producer"), rows.withColumn("price", F.col("price") + 1))]
    back = publication.committed(spark, home, rows.schema).groupBy("series").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    return back.select("*", F.lit(one).alias("one"), F.lit(again).alias("again"), F.lit(other).alias("other"))


@query(with_(TICKS_SQL, ' SELECT series, off AS "offset", price FROM ticks WHERE off > 500'))
def a10_offset_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The archive in two appended segments, read as a stream behind offset 500: half, and from its own log the rest."""
    rows, home, out = ticks(spark, sf).select("series", "offset", "price"), fresh(spark, "archive"), fresh(spark, "tail")
    middle = rows.agg(F.expr("(min(offset) + max(offset)) div 2")).first()[0]
    spark.dataSource.register(OffsetArchive)
    for part in (rows.where(F.col("offset") <= middle), rows.where(F.col("offset") > middle)):
        publication.append(part, home, "offset")
        stream = spark.readStream.format("offset_archive").schema(rows.schema).option("path", home).option("after", 500).load()
        run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
