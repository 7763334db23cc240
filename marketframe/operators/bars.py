"""Queries over the bar table (S6-S10, A1, A4) as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, KEY, require_columns
from ..sources.readers import date_range


def scan(bars: DataFrame, tickers: Iterable[str] | str | None = None,
         start: str | None = None, end: str | None = None, *, ordered: bool = True) -> DataFrame:
    """Bars of tickers over an inclusive range, in (Ticker, Date) order.

    The sort is the output contract; callers that feed another operator
    should pass ``ordered=False`` and let that operator order its windows.
    """
    if isinstance(tickers, str):
        tickers = [tickers]
    df = bars
    if tickers is not None:
        df = df.where(F.col("Ticker").isin(list(tickers)))
    df = date_range(df, start, end)
    return df.orderBy("Ticker", "Date") if ordered else df


def latest_date(bars: DataFrame) -> DataFrame:
    """Latest stored date of every ticker."""
    return bars.groupBy("Ticker").agg(F.max("Date").alias("latest_date"))


def tickers(bars: DataFrame) -> DataFrame:
    """Distinct tickers."""
    return bars.select("Ticker").distinct()


def latest_bars(bars: DataFrame, n: int = 1) -> DataFrame:
    """The last n bars of every ticker (top-n by date, no clock)."""
    w = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
    return bars.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def summary(bars: DataFrame) -> DataFrame:
    """A1: mean / max / min close and total volume per ticker (partial + final agg)."""
    return bars.groupBy("Ticker").agg(
        F.avg("Close").alias("mean_close"),
        F.max("Close").alias("max_close"),
        F.min("Close").alias("min_close"),
        F.sum("Volume").cast("bigint").alias("total_volume"),
    )


def counts(bars: DataFrame) -> DataFrame:
    """A4: rows per ticker and the date span they cover."""
    return bars.groupBy("Ticker").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )


def upsert_result(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Table content after replacing (Ticker, Date) keys with ``new``.

    Only tickers present in ``new`` change; the result holds exactly those
    tickers' rows (existing minus replaced keys, plus new), which is what a
    dynamic partition overwrite writes back. Both inputs are reduced by the
    key join, shuffled once on the key.
    """
    require_columns(new, BAR_COLUMNS)
    new = new.select(*BAR_COLUMNS)
    touched = new.select("Ticker").distinct()
    kept = (existing.select(*BAR_COLUMNS)
            .join(touched, "Ticker", "left_semi")
            .join(new.select(*KEY), list(KEY), "left_anti"))
    return kept.unionByName(new)


def merged_table(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Whole table after the upsert: existing rows minus the replaced keys, plus
    the batch (one anti join on the key; untouched tickers pass through it)."""
    require_columns(new, BAR_COLUMNS)
    new = new.select(*BAR_COLUMNS)
    kept = existing.select(*BAR_COLUMNS).join(new.select(*KEY), list(KEY), "left_anti")
    return kept.unionByName(new)


def duplicate_keys(batch: DataFrame) -> DataFrame:
    """Keys that occur more than once in a batch (they would violate the PK)."""
    return batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
