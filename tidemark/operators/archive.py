"""Archives, pages and files: writers, checked scans and loaders."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR_NS, canonical_decimal, utc_date
from tidemark.operators.scan import BLOCK_OFFSETS, neighbours

#: The closed schema of a raw envelope archive: names and types are fixed.
RAW_SCHEMA = (
    "offset bigint, producer string, epoch string, source string, stream string, channel string, adapter_version string, "
    "receipt_wall_time_ns bigint, receipt_monotonic_ns bigint, receipt_session_id string, quality_epoch string, quality_status string, "
    "quality_offset_ns bigint, quality_uncertainty_ns bigint, quality_evidence_age_ns bigint, subject_type string, subject_first string, "
    "subject_second string, subject_third string, source_time_value bigint, source_time_unit string, source_event_id string, "
    "source_sequence bigint, payload binary, content_sha256 string"
)
#: Columns of a monthly archive of hourly candles, all read as text; fixed order.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")


def write_once(rows: DataFrame, path: str, by: list[str]) -> None:
    """An immutable archive, zstd, partitioned; a folder that exists is an error."""
    rows.write.mode("errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def raw_scan(spark: SparkSession, path: str) -> DataFrame:
    """A1: the raw archive by its closed schema, with ``fault`` where a row breaks its own evidence.

    Nothing is inferred: the hash is compared with the stored one, and identity and time columns must be there. Whether offsets
    rise as written is told by ``written_order``.
    """
    rows = spark.read.schema(RAW_SCHEMA + ", event_family string, utc_date string").parquet(path)
    fault = (
        F.when(F.col("offset").isNull() | F.col("producer").isNull() | F.col("payload").isNull(), "missing-identity")
        .when(~F.coalesce(F.sha2("payload", 256) == F.col("content_sha256"), F.lit(False)), "payload-hash")
        .when(F.col("utc_date") != utc_date(F.col("receipt_wall_time_ns")), "wrong-partition")
    )
    return rows.withColumn("fault", fault)


def written_order(rows: DataFrame, keys: list[str], span: int = BLOCK_OFFSETS) -> DataFrame:
    """A1: of each segment the rows whose offset is not above that of the row before them in their file, as they lie there.

    rows come straight from a Parquet scan, which tells each row's file and place; a row without an offset is out of order, and
    the row behind it has nothing to be compared with. Files are read in blocks of places, so one long file is no one task.
    """
    at = rows.select(*keys, "offset", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    at = neighbours(at, ["_file"], "_place", span, {"_before": "offset"})
    bad = F.col("offset").isNull() | F.coalesce(F.col("offset") <= F.col("_before"), F.lit(False))
    return at.groupBy(*keys).agg(F.count("*").alias("records"), F.count_distinct("_file").alias("files"), F.count_if(bad).alias("disordered"))


def audited(rows: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and offsets of each segment against its manifest (keys, records, first_offset, last_offset)."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("offset").alias("_lo"), F.max("offset").alias("_hi"), F.count_distinct("offset").alias("_d"), F.count("fault").alias("faults"))
    out = manifest.join(seen, keys, "full_outer")
    state = (
        F.when(F.col("records").isNull(), "not-in-manifest").when(F.col("_n").isNull(), "missing-object").when(F.col("_n") != F.col("records"), "record-count")
        .when(F.col("_d") != F.col("_n"), "repeated-offset").when((F.col("_lo") != F.col("first_offset")) | (F.col("_hi") != F.col("last_offset")), "offset-range").when(F.col("faults") > 0, "payload").otherwise("ok")
    )
    return out.select(*keys, F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), state.alias("state"))


def monthly_hourly(spark: SparkSession, path: str) -> DataFrame:
    """A4: CSV files <path>/symbol=<s>/month=<yyyy-mm>/*.csv of 12 columns, with an optional header row each.

    symbol, month, start_ns, close, row_sha256 and reason: null for a good candle, else the first rule it breaks; the
    caller keeps broken rows apart instead of dropping them. Row and file make the lineage hash.
    """
    schema = ", ".join(f"{c} string" for c in KLINE_COLUMNS) + ", extra string"
    rows = spark.read.schema(schema + ", symbol string, month string").option("mode", "PERMISSIVE").csv(path)
    return judged_klines(rows.withColumn("file", F.col("_metadata.file_name")))


def zipped_hourly(files: DataFrame) -> DataFrame:
    """A4 for zipped months: files(path, content) as the binaryFile source reads <path>/symbol=<s>/month=<yyyy-mm>/<name>.zip.

    A task unpacks a file line by line, nothing is written. A file holds one member, <name>.csv; any other has one row with
    the reason ``archive-member``, a file that is no zip or fails its checksum one with ``archive-damaged`` behind what could be read.
    The file's own SHA-256 takes the place of its name in the lineage.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                sha, name, fault, text = hashlib.sha256(content).hexdigest(), path.rsplit("/", 1)[-1].removesuffix(".zip"), None, []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as packed:
                        if packed.namelist() != [f"{name}.csv"]:
                            fault = "archive-member"
                        else:
                            with packed.open(f"{name}.csv") as member:
                                for raw in member:
                                    if line := raw.decode("utf-8", "replace").rstrip("\r\n"):
                                        text.append(line)
                                    if len(text) == 10_000:
                                        yield written(path, sha, text, None)
                                        text = []
                except (zipfile.BadZipFile, EOFError, zlib.error):
                    fault = "archive-damaged"
                yield written(path, sha, [*text, *([None] if fault else [])], fault)

    def written(path: str, sha: str, text: list, fault: str | None) -> pa.RecordBatch:
        faults = [fault if line is None else None for line in text]
        columns = [pa.array([x] * len(text), pa.string()) for x in (path, sha)] + [pa.array(text, pa.string()), pa.array(faults, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "file", "line", "fault"])

    rows = files.select("path", "content").mapInArrow(lines, "path string, file string, line string, fault string")
    place = [F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("symbol", "month")]
    parsed = F.from_csv("line", ", ".join(f"{c} string" for c in KLINE_COLUMNS) + ", extra string", {"mode": "PERMISSIVE"})
    return judged_klines(rows.select(*place, "file", "fault", parsed.alias("r")).select("symbol", "month", "file", "fault", "r.*"))


def judged_klines(rows: DataFrame) -> DataFrame:
    """symbol, month, start_ns, close, row_sha256 and reason of kline rows in text with their file; header rows go."""
    rows = rows.where(~(F.col("open_time").eqNullSafe(F.lit("open_time")) & F.col("open").eqNullSafe(F.lit("open"))))
    number = {c: F.col(c).try_cast("decimal(38,12)") for c in ("open", "high", "low", "close", "volume")}
    start, end, trades = F.col("open_time").try_cast("bigint"), F.col("close_time").try_cast("bigint"), F.col("count").try_cast("bigint")
    values = start.isNotNull() & end.isNotNull() & trades.isNotNull()
    for c in number.values():
        values &= c.isNotNull()
    sane = (number["low"] > 0) & (number["volume"] >= 0) & (trades >= 0) & (number["low"] <= F.least(number["open"], number["close"])) & (F.greatest(number["open"], number["close"]) <= number["high"])
    reason = (
        F.coalesce(F.col("fault") if "fault" in rows.columns else F.lit(None).cast("string"), F.when(F.col("ignore").isNull() | F.col("extra").isNotNull(), "row-width").when(~values, "row-value").when((start < 0) | (F.pmod(start, F.lit(3_600_000)) != 0) | (end != start + 3_599_999), "close-time")
        .when(utc_month(start) != F.col("month"), "outside-month").when(~sane, "ohlc-or-volume"))
    )
    lineage = F.sha2(F.concat_ws("|", "file", *[F.coalesce(F.col(c), F.lit("")) for c in KLINE_COLUMNS]), 256)
    return rows.select("symbol", "month", (start * 1_000_000).alias("start_ns"), number["close"].alias("close"), lineage.alias("row_sha256"), reason.alias("reason"))


def utc_month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def page_candles(pages: DataFrame, start_ms: Column, before_ms: Column) -> DataFrame:
    """A5: pages(page, body: JSON with result.symbol and result.list of 7 texts, newest first) flattened, clipped to
    [start, before) and merged: one candle a key with the pages that hold it; unequal repeats are a conflict, of which the
    one whose values are least as numbers stands (by its texts where they are equal, what is no number first)."""
    shape = "struct<result:struct<symbol:string,list:array<array<string>>>>"
    rows = pages.withColumn("d", F.from_json("body", shape)).select("page", F.col("d.result.symbol").alias("symbol"), F.explode("d.result.list").alias("row"))
    rows = rows.where(F.size("row") == 7).withColumn("start_ms", F.get("row", F.lit(0)).try_cast("bigint"))
    rows = rows.where((F.col("start_ms") >= start_ms) & (F.col("start_ms") < before_ms))
    text = F.array_join("row", ",")
    value = F.struct(F.transform("row", lambda x: x.try_cast("decimal(38,18)")), "row")
    out = rows.groupBy("symbol", "start_ms").agg(F.min_by("row", value).alias("row"), F.count("*").alias("n_pages"), (F.min(text) != F.max(text)).alias("conflict"))
    return out.select("symbol", "start_ms", F.get("row", F.lit(4)).alias("close"), "n_pages", "conflict")


def instruments(pages: DataFrame) -> DataFrame:
    """pages(body: JSON of result.category and result.list) to the instrument dimension.

    Volume is counted in the quote of inverse instruments and in the base of others; spot takes its quantity step from
    basePrecision. The revision is the head of the hash of all descriptive fields. Repeats that agree are one row,
    others are a conflict.
    """
    item = "struct<symbol:string,baseCoin:string,quoteCoin:string,status:string,contractType:string,priceFilter:struct<tickSize:string>,lotSizeFilter:struct<qtyStep:string,basePrecision:string>,launchTime:string,deliveryTime:string,settleCoin:string,contractSize:string>"
    rows = pages.withColumn("d", F.from_json("body", f"struct<result:struct<category:string,list:array<{item}>>>"))
    rows = rows.select(F.col("d.result.category").alias("category"), F.explode("d.result.list").alias("i")).select("category", "i.*")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    step = F.when(F.col("category") == "spot", F.coalesce("lotSizeFilter.basePrecision", "lotSizeFilter.qtyStep")).otherwise(F.col("lotSizeFilter.qtyStep"))
    delivery = F.coalesce(F.col("deliveryTime").try_cast("bigint"), F.lit(0))
    out = rows.select(
        "category", "symbol", F.col("baseCoin").alias("base"), F.col("quoteCoin").alias("quote"), "status", F.coalesce("contractType", F.lit("Spot")).alias("contract_type"),
        canonical_decimal(F.col("priceFilter.tickSize")).alias("price_increment"), canonical_decimal(step).alias("quantity_increment"), blank("settleCoin").alias("settlement"), canonical_decimal(blank("contractSize")).alias("multiplier"),
        F.when(F.col("category") == "inverse", F.col("quoteCoin")).otherwise(F.col("baseCoin")).alias("volume_unit"), F.when(delivery > 0, delivery * 1_000_000).alias("expiry_ns"), F.coalesce("launchTime", F.lit("0")).alias("launch"))
    body = F.to_json(F.struct("base", "category", "contract_type", "expiry_ns", "launch", "multiplier", "price_increment", "quantity_increment", "quote", "settlement", "status"), {"ignoreNullFields": "false"})
    out = out.withColumn("revision", F.concat(F.lit("v5-"), F.substring(F.sha2(body, 256), 1, 24)))
    by = out.groupBy("category", "symbol").agg(F.count("*").alias("n_pages"), (F.min("revision") != F.max("revision")).alias("conflict"), F.min_by(F.struct("base", "quote", "price_increment", "quantity_increment", "settlement", "multiplier", "volume_unit", "expiry_ns", "revision"), "revision").alias("x"))
    return by.select("category", "symbol", "n_pages", "conflict", "x.*")


def hourly_intake(messages: DataFrame, dimension: DataFrame, delay_ns: int) -> DataFrame:
    """messages(body: JSON of symbol, origin_ms, close_ms, close, server_ms, received_ns, uncertainty_ns) as observations.

    state: unknown-instrument, not-final (the server's time has not passed the close), wrong-origin, late (received
    behind origin + delay for sure) or accepted; available_ns is the latest plausible time of receipt.
    """
    shape = "struct<symbol:string,origin_ms:bigint,close_ms:bigint,close:string,server_ms:bigint,received_ns:bigint,uncertainty_ns:bigint>"
    rows = messages.select(F.from_json("body", shape).alias("m")).select("m.*").join(dimension.select("symbol", "volume_unit"), "symbol", "left")
    available = F.greatest((F.col("close_ms") + 1) * 1_000_000, F.col("received_ns") + F.col("uncertainty_ns"))
    state = (
        F.when(F.col("volume_unit").isNull(), "unknown-instrument").when(F.col("close_ms") != F.col("origin_ms") + HOUR_NS // 1_000_000 - 1, "wrong-origin").when(F.col("server_ms") <= F.col("close_ms"), "not-final")
        .when(F.col("received_ns") - F.col("uncertainty_ns") > (F.col("close_ms") + 1) * 1_000_000 + delay_ns, "late").otherwise("accepted")
    )
    return rows.select("symbol", "origin_ms", canonical_decimal(F.col("close")).alias("close"), "volume_unit", available.alias("available_ns"), state.alias("state"))


def corpus(files: DataFrame) -> DataFrame:
    """files(body: JSON of records, each symbol, payload, sha256): a row a record with what is wrong with it."""
    rows = files.select(F.explode(F.from_json("body", "struct<records:array<struct<symbol:string,payload:string,sha256:string>>>")["records"]).alias("r")).select("r.*")
    repeats = rows.groupBy("symbol").agg(F.count("*").alias("_n"))
    rows = rows.join(repeats, "symbol", "left")
    fault = F.when(~F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)), "payload-hash").when(F.col("_n") > 1, "repeated-symbol")
    return rows.select("symbol", F.octet_length("payload").cast("bigint").alias("n_bytes"), fault.alias("fault"))


def content_digest(rows: DataFrame) -> DataFrame:
    """L5, order-insensitive: count, and the sum of the rows' hashes modulo 2**64 and their exclusive or, both as text.

    A commutative aggregate: no rows are gathered, so it holds at any size.
    """
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("bigint")
    return rows.select(part.alias("h")).agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string").alias("hash_xor"))


def exported(rows: DataFrame, policy: dict, path: str) -> None:
    """Data, manifest, policy and receipt of a data set below one folder."""
    spark = rows.sparkSession
    write_once(rows, f"{path}/data", [])
    digest = content_digest(spark.read.schema(rows.schema).parquet(f"{path}/data"))
    digest.withColumn("columns", F.lit(",".join(rows.columns))).write.json(f"{path}/manifest")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(policy.items())], "name string, value string").coalesce(1).write.json(f"{path}/policy")
    digest.select(F.sha2(F.concat_ws("|", "records", "hash_sum", "hash_xor"), 256).alias("receipt_sha256")).write.json(f"{path}/receipt")


def imported(spark: SparkSession, path: str, schema) -> DataFrame:
    """The bundle's figures read again, beside those its manifest states; the receipt must be their hash."""
    have = content_digest(spark.read.schema(schema).parquet(f"{path}/data"))
    said = spark.read.schema("records bigint, hash_sum string, hash_xor string, columns string").json(f"{path}/manifest").withColumnRenamed("records", "said")
    receipt = spark.read.schema("receipt_sha256 string").json(f"{path}/receipt")
    n = spark.read.schema("name string, value string").json(f"{path}/policy").agg(F.count("*").alias("policies"))
    same = (F.col("said") == F.col("records")) & (said["hash_sum"] == have["hash_sum"]) & (said["hash_xor"] == have["hash_xor"])
    right = F.sha2(F.concat_ws("|", "records", have["hash_sum"], have["hash_xor"]), 256) == F.col("receipt_sha256")
    return have.join(said).join(receipt).join(n).select("records", "policies", "columns", same.alias("same"), right.alias("receipt_right"))  # a row each
