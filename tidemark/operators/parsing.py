"""Strict parsing of candle payloads (B1, B2, B3, B14): the first failing rule of each row as code and field, no UDF.

A payload that fails never stops a job. JSON becomes a variant, which refuses malformed text and repeated keys; what
the variant hides (the length of number tokens) is read from the text with its string literals taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import INTERVAL_MINUTES, ohlc_consistent

#: Bytes of a payload, digits of an integer token, characters of another number token and of decimal text: fixed limits.
PAYLOAD_BYTES, VENUE_PAYLOAD_BYTES, INTEGER_TOKEN, NUMBER_TOKEN, DECIMAL_TEXT, DECIMAL_DIGITS = 4096, 8192, 20, 128, 128, 96
#: Field sets of the message and its parts, fixed values.
FIELDS = ("schema", "start_ns", "interval_ns", "open", "high", "low", "close", "volume", "finalized", "publication_time")
VENUE_FIELDS = (*FIELDS, "category", "symbol", "interval", "row")
SCHEMA_FIELDS = ("name", "major", "minor")
TIME_FIELDS = ("value", "unit")
UNITS = ("s", "ms", "us", "ns")
PRICES = ("open", "high", "low", "close", "volume")
CATEGORIES = ("spot", "linear", "inverse")


def kind(path: str) -> Column:
    """The variant's type at the path, NULL where nothing is."""
    return F.schema_of_variant(F.expr(f"try_variant_get(v, '{path}', 'variant')"))


def value(path: str, type_: str = "string") -> Column:
    return F.expr(f"try_variant_get(v, '{path}', '{type_}')")


def same_set(keys: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(keys) == F.array(*[F.lit(x) for x in sorted(names)]), F.lit(False))


def integer_fails(path: str, field: str) -> Column:
    """Code where the token at the path is no integer of 64 bits."""
    k = kind(path)
    large = k.rlike(r"^DECIMAL\((19|2[0-9]|3[0-8]),0\)$")
    return reason(F.when(large, "integer_out_of_range").when(F.coalesce(k != "BIGINT", F.lit(True)), "invalid_field_type"), field)


def decimal_fails(path: str, field: str) -> Column:
    text = value(path)
    bad = ~text.rlike(r"^[0-9]+(\.[0-9]+)?$") | (F.char_length(text) > DECIMAL_TEXT) | (F.char_length(F.replace(text, F.lit("."), F.lit(""))) > DECIMAL_DIGITS)
    return reason(F.when(F.coalesce(kind(path) != "STRING", F.lit(True)), "invalid_field_type").when(bad, "invalid_decimal"), field)


def reason(code: Column, field: str | None) -> Column:
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(field).cast("string").alias("field")))


def fails(condition: Column, code: str, field: str | None = None) -> Column:
    return reason(F.when(F.coalesce(condition, F.lit(True)), code), field)


def decoded(raw: DataFrame, most_bytes: int) -> DataFrame:
    """raw(payload binary, ...) with v (variant), keys and json (what is wrong with the bytes as strict JSON)."""
    text = F.col("payload").cast("string")
    rows = raw.withColumn("_text", F.when(F.expr("is_valid_utf8(cast(payload as string))") & (F.octet_length("payload") <= most_bytes), text))
    bare = F.regexp_replace("_text", r'"(?:[^"\\]|\\.)*+"', '""')
    rows = rows.withColumn("_bare", bare).withColumn("v", F.try_parse_json("_text"))
    tokens = F.regexp_extract_all("_bare", F.lit(r"-?[0-9][0-9.eE+-]*"), F.lit(0))
    long = F.exists(tokens, lambda t: F.when(t.rlike("^-?[0-9]+$"), F.char_length(t) > INTEGER_TOKEN).otherwise(F.char_length(t) > NUMBER_TOKEN))
    loose = F.get_json_object("_text", "$").isNull() | F.col("_bare").rlike(r"[^\[\]{}:,0-9eE+.\"\sa-z-]|nan|infinity|NaN|Infinity")
    json = F.coalesce(
        reason(F.when(F.octet_length("payload") > most_bytes, "payload_too_large"), None),
        reason(F.when(F.col("_text").isNull(), "invalid_utf8"), None),
        reason(F.when(loose, "invalid_json"), None),
        reason(F.when(F.col("v").isNull() & ~long, "duplicate_json_key"), None),
        reason(F.when(long, "json_token_too_long"), None),
    )
    return rows.withColumn("json", json).withColumn("keys", F.json_object_keys("_text")).drop("_text", "_bare")


def schema_fails(rows: DataFrame) -> Column:
    ints = [F.coalesce(kind(f"$.schema.{c}") == "BIGINT", F.lit(False)) for c in ("major", "minor")]
    well = same_set(F.json_object_keys(F.to_json(F.expr("try_variant_get(v, '$.schema', 'variant')"))), SCHEMA_FIELDS) & F.coalesce(kind("$.schema.name") == "STRING", F.lit(False))
    well = well & ints[0] & ints[1] & (value("$.schema.major", "bigint") >= 1) & (value("$.schema.minor", "bigint") >= 0)
    return fails(~F.coalesce(well, F.lit(False)), "invalid_schema", "schema")


def readable(name: str, major: int, minor: int) -> Column:
    """The declared schema has this name and major, and a minor that is not newer."""
    return F.coalesce((value("$.schema.name") == name) & (value("$.schema.major", "bigint") == major) & (value("$.schema.minor", "bigint") <= minor), F.lit(False))


def publication_fails() -> Column:
    path, field = "$.publication_time", "publication_time"
    inner = F.coalesce(
        fails(~F.startswith(kind(path), F.lit("OBJECT")), "invalid_field_type", field),
        fails(~same_set(F.json_object_keys(F.to_json(F.expr(f"try_variant_get(v, '{path}', 'variant')"))), TIME_FIELDS), "field_set_mismatch", field),
        integer_fails(f"{path}.value", field),
        fails(kind(f"{path}.unit") != "STRING", "invalid_field_type", field),
        fails(~value(f"{path}.unit").isin(*UNITS), "invalid_time", field),
    )
    return F.when(kind(path) != "VOID", inner)


def priced(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.expr(f"try_cast(try_variant_get(v, '$.{c}', 'string') as decimal(38,18))") for c in PRICES})


def parsed(raw: DataFrame) -> DataFrame:
    """B1, B2: raw(payload, has_subject, ...) with status (accepted, unsupported, rejected), code, field and the values.

    Decimals of more than 20 whole or 18 further digits pass the syntax but do not fit the values' type (B19).
    """
    rows = priced(decoded(raw, PAYLOAD_BYTES))
    supported = readable("fake_candle", 1, 0) & (value("$.schema.minor", "bigint") == 0)
    ohlc = ohlc_consistent(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    of_candle = F.coalesce(
        fails(~same_set(F.col("keys"), FIELDS), "field_set_mismatch"),
        integer_fails("$.start_ns", "start_ns"), integer_fails("$.interval_ns", "interval_ns"),
        fails(value("$.start_ns", "bigint") < 0, "invalid_time", "start_ns"), fails(value("$.interval_ns", "bigint") <= 0, "invalid_time", "interval_ns"),
        *[decimal_fails(f"$.{c}", c) for c in PRICES],
        fails(~ohlc, "inconsistent_ohlc"), fails(kind("$.finalized") != "BOOLEAN", "invalid_field_type", "finalized"),
        publication_fails(), fails(~F.col("has_subject"), "invalid_subject", "subject"),
    )
    rows = rows.withColumn("_head", F.coalesce("json", fails(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")) | ~F.array_contains("keys", "schema"), "invalid_schema", "schema"), schema_fails(rows)))
    rows = rows.withColumn("_bad", F.coalesce("_head", F.when(supported, of_candle)))
    status = F.when(F.col("_bad").isNotNull(), "rejected").when(supported, "accepted").otherwise("unsupported")
    keep = [c for c in raw.columns if c != "payload"]
    values = [F.when(status == "accepted", c).alias(n) for n, c in (("start_ns", value("$.start_ns", "bigint")), ("interval_ns", value("$.interval_ns", "bigint")), *((p, F.col(p)) for p in PRICES), ("finalized", value("$.finalized", "boolean")))]
    return rows.select(*keep, status.alias("status"), F.col("_bad.code").alias("code"), F.col("_bad.field").alias("field"), *[v for v in values])


def venue_parsed(raw: DataFrame) -> DataFrame:
    """raw(payload, category, symbol, channel, source_ms, ...): the venue's message, whose values must agree with its own
    row of seven texts, with the subject, the channel and the source time."""
    rows = priced(decoded(raw, VENUE_PAYLOAD_BYTES))
    minutes = F.create_map(*[F.lit(x) for code, n in INTERVAL_MINUTES.items() for x in (code, n)])
    code = value("$.interval")
    ns = F.try_element_at(minutes, code).cast("bigint") * 60_000_000_000
    subject = (
        (value("$.category") == F.col("category")) & value("$.category").isin(*CATEGORIES) & (value("$.symbol") == F.col("symbol")) & ns.isNotNull()
        & (F.col("channel") == F.concat(F.lit("kline-"), code)) & (kind("$.interval_ns") == "BIGINT") & (value("$.interval_ns", "bigint") == ns)
    )
    row = value("$.row", "array<string>")
    time = (
        (kind("$.row") == "ARRAY<STRING>") & (F.size(row) == 7) & F.get(row, F.lit(0)).rlike("^[0-9]+$") & (F.get(row, F.lit(0)).cast("string") == F.col("source_ms").cast("string"))
        & (kind("$.start_ns") == "BIGINT") & (value("$.start_ns", "bigint") == F.col("source_ms") * 1_000_000)
    )
    plain = lambda t: t.rlike(r"^(0|[1-9][0-9]*)(\.[0-9]+)?$") & (F.char_length(t) <= DECIMAL_TEXT)
    number = lambda t: F.expr("try_cast(x as decimal(38,18))") if t is None else t.try_cast("decimal(38,18)")
    prices = [fails(~(plain(value(f"$.{c}")) & plain(F.get(row, F.lit(i))) & (kind(f"$.{c}") == "STRING") & (F.col(c) == number(F.get(row, F.lit(i))))), "invalid_decimal", c) for i, c in enumerate(PRICES, 1)]
    published = F.col("v").isNotNull() & (
        (kind("$.publication_time") == "VOID")
        | (same_set(F.json_object_keys(F.to_json(F.expr("try_variant_get(v, '$.publication_time', 'variant')"))), TIME_FIELDS) & (kind("$.publication_time.value") == "BIGINT")
           & (value("$.publication_time.value", "bigint") >= 0) & (value("$.publication_time.value", "bigint") < 9_223_372_036_854) & (value("$.publication_time.unit") == "ms"))
    )
    ohlc = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))
    of_candle = F.coalesce(
        fails(~same_set(F.col("keys"), VENUE_FIELDS), "field_set_mismatch"), fails(~F.coalesce(subject, F.lit(False)), "invalid_subject", "subject"),
        fails(~F.coalesce(time, F.lit(False)), "invalid_time", "start_ns"), *prices, fails(~plain(F.get(row, F.lit(6))), "invalid_decimal", "volume"),
        fails(~ohlc, "inconsistent_ohlc"), fails(kind("$.finalized") != "BOOLEAN", "invalid_field_type", "finalized"), fails(~F.coalesce(published, F.lit(False)), "invalid_time", "publication_time"),
    )
    declared = F.coalesce(fails(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "invalid_schema", "schema"), schema_fails(rows), fails(value("$.schema.name") != "bybit_candle", "invalid_schema", "schema"))
    rows = rows.withColumn("_bad", F.coalesce("json", declared, F.when(readable("bybit_candle", 1, 0), of_candle)))
    status = F.when(F.col("_bad").isNotNull(), "rejected").when(readable("bybit_candle", 1, 0), "accepted").otherwise("unsupported")
    keep = [c for c in raw.columns if c != "payload"]
    return rows.select(*keep, status.alias("status"), F.col("_bad.code").alias("code"), F.col("_bad.field").alias("field"))
