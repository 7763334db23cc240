"""Constants and small bar frames shared by the tests (imported by name, so the
module name must stay unique below ``tests/``)."""

import datetime as dt

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"

BAR_SCHEMA = "Date date, Ticker string, Open double, High double, Low double, Close double, Volume bigint"


def ramp(spark, n=100, ticker="AAPL", start=dt.date(2024, 1, 1), base=100.0, volume=1_000_000):
    """O = C = base + k, H = C + 1, L = C - 1, daily dates."""
    rows = [(start + dt.timedelta(days=k), ticker, base + k, base + k + 1, base + k - 1, base + k, volume)
            for k in range(n)]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def bars_of(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)
