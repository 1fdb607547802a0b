"""Queries that run as streams over the driver tables. The catalog imports this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import H, KIND_SQL, query, with_
from tidemark.functions.expressions import DAY_NS, semantic_revision
from tidemark.operators import parsing
from tidemark.sources.scratch import fresh
from tidemark.sources.views import BARS_SQL, OBS_SQL, TICKS_SQL, bars
from tidemark.streaming import replay, stateful


@query(with_(TICKS_SQL, ' SELECT DISTINCT series, producer, ns, price FROM ticks'))
def d9_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Replayed ticks of equal content count once."""
    s = replay.tick_stream(spark, sf)
    twice = s.union(replay.tick_stream(spark, sf))
    return replay.drained(replay.deduplicated(twice, ["series", "producer", "ns", "price"]).select("series", "producer", "ns", "price"), "dedup")


@query(with_(BARS_SQL, f' SELECT series, start_ns, start_ns + {H} AS end_ns, open, high, low, "close", n FROM bars WHERE start_ns + {H} <= (SELECT max(ns) - {H} FROM ticks)'))
def h12_stream_candles(spark: SparkSession, sf: str) -> DataFrame:
    """Candles whose end the watermark (an hour behind the last tick) has passed."""
    return replay.drained(replay.hourly(replay.tick_stream(spark, sf)), "candles")


@query(with_(OBS_SQL, KIND_SQL + ' SELECT series, start_ns, off AS "offset", kind FROM kinds'))
def d2_stream_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The stream gives what the batch query d1_classify gives."""
    t = replay.tick_stream(spark, sf).withColumn("start_ns", F.col("ns") - F.pmod(F.col("ns"), F.lit(6 * H)))
    t = t.withColumn("price", F.floor(F.col("price") / 20) * 20).withColumn("finalized", F.pmod("offset", F.lit(9)) == 0)
    t = t.withColumn("revision", semantic_revision(F.col("series"), F.col("start_ns"), F.col("price").cast("bigint"), F.col("finalized")))
    return replay.drained(stateful.classified(t.select("series", "start_ns", "offset", "revision", "finalized")), "classified")


@query("""WITH c AS (SELECT conv_id AS stream, turn * 2 AS off, turn AS seq, turn = 0 AS snap FROM conversations WHERE length(text) >= 100 OR turn = 0),
again AS (SELECT conv_id, turn * 2 + 1, turn - 1, false FROM conversations WHERE role = 'user' AND turn >= 2 AND length(text) >= 400),
r AS (SELECT * FROM c UNION ALL SELECT * FROM again), h AS (SELECT *, max(seq) OVER (PARTITION BY stream ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM r),
k AS (SELECT *, CASE WHEN snap THEN NULL WHEN seq <= high THEN 'late' WHEN seq > high + 1 THEN 'gap' END AS kind FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY stream, kind ORDER BY off) AS rk FROM k)
SELECT stream, kind, CASE WHEN kind = 'gap' THEN high + 1 ELSE seq END AS first_seq, CASE WHEN kind = 'gap' THEN seq - 1 ELSE seq END AS last_seq, off AS "offset" FROM f WHERE kind IS NOT NULL
UNION ALL SELECT stream, 'book-loss', seq, seq, off FROM f WHERE kind = 'gap' AND rk = 1""")
def h10_stream_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as numbers of a stream: short turns are lost, long user turns repeat the number before them, too late."""
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    c = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    kept = c.where("length(text) >= 100 or turn = 0").select(F.col("conv_id").alias("stream"), (F.col("turn") * 2).alias("offset"), F.col("turn").alias("seq"), (F.col("turn") == 0).alias("snapshot"))
    again = c.where("role = 'user' and turn >= 2 and length(text) >= 400").select(F.col("conv_id").alias("stream"), (F.col("turn") * 2 + 1).alias("offset"), (F.col("turn") - 1).alias("seq"), F.lit(False).alias("snapshot"))
    return replay.drained(stateful.sequence_gaps(kept.union(again)), "sequences")


@query(with_(TICKS_SQL, f""" SELECT series, strftime(make_timestamp(ns // 1000), '%Y-%m-%d') AS utc_date, CASE (ns // {H}) % 24 WHEN 3 THEN 'rejected' WHEN 5 THEN 'rejected' WHEN 7 THEN 'unsupported' ELSE 'accepted' END AS status,
CASE (ns // {H}) % 24 WHEN 3 THEN 'invalid_decimal' WHEN 5 THEN 'field_set_mismatch' END AS code, count(*) AS n FROM ticks GROUP BY 1, 2, 3, 4"""))
def h11_stream_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads parsed batch by batch and published; hour 3 has a broken price, 5 one field too many, 7 a later schema."""
    hour = F.expr(f"ns div {H} % 24")
    price = F.concat(F.lit('"'), F.when(hour == 3, "x").otherwise(F.col("price").cast("decimal(18,2)").cast("string")), F.lit('"'))
    head = F.concat(F.lit('{"schema":{"name":"fake_candle","major":'), F.when(hour == 7, "2").otherwise("1"), F.lit(',"minor":0},"start_ns":'), F.col("ns").cast("string"), F.lit(f',"interval_ns":{H}'))
    body = F.concat(head, *[x for c in parsing.PRICES for x in (F.lit(f',"{c}":'), price)], F.lit(',"finalized":true,"publication_time":null'), F.when(hour == 5, ',"more":1}').otherwise("}"))

    def batch(rows: DataFrame) -> DataFrame:
        raw = rows.select("series", F.date_format("ts", "yyyy-MM-dd").alias("utc_date"), F.lit(True).alias("has_subject"), body.cast("binary").alias("payload"))
        return parsing.parsed(raw).select("series", "utc_date", "status", "code")

    out = stateful.published(replay.tick_stream(spark, sf), batch, "published")
    return out.groupBy("series", "utc_date", "status", "code").agg(F.count("*").alias("n"))


@query(with_(BARS_SQL, f""", g AS (SELECT *, (start_ns // {H}) % 24 AS h, start_ns // {DAY_NS} * 4 + (start_ns // {H}) % 24 // 6 AS part FROM bars), k AS (SELECT *, CASE WHEN h // 6 = 3 THEN start_ns // {DAY_NS} * 4 + 2 ELSE part END AS batch FROM g), m AS (SELECT *, count(*) OVER (PARTITION BY series, batch) AS size FROM k)
SELECT series AS symbol, start_ns // 1000000 AS start_ms, CAST(CAST("close" AS DECIMAL(18, 2)) AS VARCHAR) AS "close", CASE WHEN size > 8 THEN 'bad-batch' WHEN h = 4 THEN 'bad-boundary' ELSE 'accepted' END AS state, finalized AND h NOT IN (4, 5) AS finalized FROM m"""))
def a7_stream_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Topic messages in JSON files of candles of six hours (twelve in the afternoon, which is too many), read as a stream;
    hour 4 ends too late (behind its own clock), the source's clock of hour 5 has not passed the close."""
    h = F.expr(f"start_ns div {H} % 24")
    part = F.expr(f"start_ns div {DAY_NS} * 4") + F.when(h >= 12, 2).otherwise(F.floor(h / 6))
    ms, end = F.expr("start_ns div 1000000"), F.expr("start_ns div 1000000") + 3_599_999
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string").alias(c)
    k = F.struct(ms.alias("start"), F.when(h == 4, end + 1).otherwise(end).alias("end"), F.lit("60").alias("interval"), text("open"), text("close"), text("high"), text("low"), F.col("n").cast("string").alias("volume"), F.col("finalized").alias("confirm"), F.when(h == 5, end).otherwise(end + 1).alias("timestamp"))
    messages = bars(spark, sf).groupBy("series", part.alias("part")).agg(F.collect_list(k).alias("data"))  # a message has twelve at most
    folder = fresh(spark, "topics")
    messages.select(F.concat(F.lit("kline.60."), "series").alias("topic"), F.lit(0).cast("bigint").alias("ts"), "data").repartition(8).write.json(folder)
    return replay.drained(stateful.kline_stream(spark, folder), "klines")
