"""Bar sources (S1-S4): a registry of readers that all return the bar schema.

Readers are lazy DataFrames; ticker and date predicates are applied with
``where`` so that they reach the file scan (partition pruning on Ticker when
the data is partitioned by it, row-group pruning on Date).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, OHLCV, conform
from . import adapters

Reader = Callable[..., DataFrame]


def _files(fmt: str) -> Reader:
    def read(spark: SparkSession, location: str) -> DataFrame:
        r = spark.read.schema(OHLCV)
        if fmt == "csv":
            r = r.option("header", "true")
        return conform(r.format(fmt).load(location))
    return read


def _table(spark: SparkSession, location: str) -> DataFrame:
    return conform(spark.table(location))


SOURCES: dict[str, Reader] = {
    "parquet": _files("parquet"),
    "csv": _files("csv"),
    "json": _files("json"),
    "table": _table,
    # tick tables of the test data, aggregated to daily bars
    "orders": adapters.bars_from_orders,
    "lineitem": adapters.bars_from_lineitem,
    "events": adapters.bars_from_events,
}


def get_source(name: str = "parquet") -> Reader:
    """Reader by name; unknown names raise ``ValueError``."""
    if name not in SOURCES:
        raise ValueError(f"Unknown provider: {name}")
    return SOURCES[name]


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date bounds; either may be omitted."""
    if start is not None:
        df = df.where(F.col("Date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("Date") <= F.to_date(F.lit(end)))
    return df


def fetch_bars(spark: SparkSession, source: str, location: str,
               tickers: Iterable[str] | None = None, start: str | None = None,
               end: str | None = None) -> DataFrame:
    """Bars of the given tickers (all when None) over an inclusive range."""
    df = get_source(source)(spark, location)
    if tickers is not None:
        df = df.where(F.col("Ticker").isin(list(tickers)))
    return date_range(df, start, end)


def require_rows(df: DataFrame, what: str = "ticker") -> DataFrame:
    """An empty fetch is an error. ``isEmpty`` reads at most one row, so the
    check costs one short job."""
    if df.isEmpty():
        raise ValueError(f"No data returned for {what}")
    return df


def normalise(vendor: DataFrame, ticker: str | Column | None = None, date_col: str = "Date") -> DataFrame:
    """Vendor frame (timestamp index as a column, extra columns) -> bar schema.

    Timestamps are truncated to the date; the ticker is a literal, a column, or
    the frame's own ``Ticker``.
    """
    if ticker is None:
        ticker = F.col("Ticker")
    t = F.lit(ticker) if isinstance(ticker, str) else ticker
    out = vendor.select(
        F.to_date(F.col(date_col)).alias("Date"),
        t.alias("Ticker"),
        *[F.col(c) for c in ("Open", "High", "Low", "Close", "Volume")],
    )
    return conform(out.select(*BAR_COLUMNS))


def missing_tickers(spark: SparkSession, requested: Iterable[str], bars: DataFrame) -> DataFrame:
    """Requested tickers that returned no bars (S4), as a DataFrame.

    The requested list is small and driver-side by nature (it is the job's
    argument); the bars side is reduced to distinct tickers before the anti
    join, so nothing large moves.
    """
    req = spark.createDataFrame([(t,) for t in dict.fromkeys(requested)], "Ticker string")
    have = bars.select("Ticker").distinct()
    return req.join(have, "Ticker", "left_anti")
