"""Archives and pages over ticks whose prices are zero or change their number of digits, against DuckDB."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import archive

DAY = dt.datetime(2024, 1, 2)


@pytest.fixture
def ticks_of(spark, tmp_path):
    def write(ticks):
        """ticks: (hour of the day, price) in one series."""
        rows = [(i, DAY + dt.timedelta(hours=h, seconds=i), 1, "click", float(p), "{}") for i, (h, p) in enumerate(ticks)]
        spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def same(spark, place, con, name):
    df = catalog.QUERIES[name](spark, place)
    rel = con.sql(catalog.SQL[name])
    got = sorted(map(tuple, df.select(*rel.columns).collect()), key=repr)
    assert got and got == sorted(rel.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", ["a4_monthly_archives", "a4_zipped_archives"])
def test_prices_of_zero(spark, ticks_of, name):
    """A candle with a low of 0, one of zeros alone, and a broken one of a cent, whose high of 0.01 would be sane."""
    place, con = ticks_of([(0, 5), (0, 0), (0, 7.25), (6, 0), (5, 0.01), (7, 3.5)])
    assert {r[2]: r[3:5] for r in same(spark, place, con, name)} == {"kept": (3, 10.75), "ohlc-or-volume": (1, None)}


def test_archives_refuse_a_low_of_zero(spark):
    """The operator itself takes no candle at zero."""
    row = {"open_time": "1704153600000", "open": "5", "high": "5", "low": "0", "close": "5", "volume": "1", "close_time": "1704157199999", "quote_volume": "0", "count": "1", "taker_buy_volume": "0", "taker_buy_quote_volume": "0", "ignore": "0"}
    rows = spark.range(1).select(F.lit("a").alias("symbol"), F.lit("2024-01").alias("month"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("extra"), *[F.lit(v).alias(c) for c, v in row.items()])
    assert [r.reason for r in archive.judged_klines(rows).collect()] == ["ohlc-or-volume"]


def test_least_page_by_value(spark, ticks_of):
    """An open candle at 9.91 stands at 10.91 in the later copy, which is less as a text only."""
    place, con = ticks_of([(1, 9.91)] * 7 + [(2, 9.5)])
    assert {r[2:] for r in same(spark, place, con, "a5_page_lists")} == {("9.91", 2, True), ("9.50", 2, False)}
