"""Incremental ingest (I1-I2): high-water mark, validation split, upsert.

One job for all tickers: the source bars are joined with the stored latest
date per ticker (one row per ticker; Spark broadcasts it only under the size
threshold), filtered to ``Date >= fetch_start`` (the latest stored day is
re-read on purpose so that a corrected last bar overwrites the stored one),
validated, and split into accepted and rejected tickers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, KEY, conform
from . import bars as B

LOOKBACK_DAYS = 365  # fixed value: default ingest window


def window_start(as_of: str | dt.date, lookback_days: int = LOOKBACK_DAYS) -> str:
    """Start of the ingest window, from an explicit ``as_of`` date (no clock)."""
    d = dt.date.fromisoformat(str(as_of)) if not isinstance(as_of, dt.date) else as_of
    return (d - dt.timedelta(days=lookback_days)).isoformat()


def incremental(source: DataFrame, stored: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Source bars from each ticker's fetch start.

    fetch_start = latest stored date if it is >= start, else start (>=, so
    the latest stored day is fetched again).
    """
    latest = B.latest_date(stored)
    s = F.to_date(F.lit(start))
    fetch_start = F.greatest(F.coalesce(F.col("latest_date"), s), s)
    src = source if end is None else source.where(F.col("Date") <= F.to_date(F.lit(end)))
    j = src.join(latest, "Ticker", "left")
    return j.where(F.col("Date") >= fetch_start).select(*BAR_COLUMNS)


def checked(batch: DataFrame) -> DataFrame:
    """One row per (Ticker, Date) key of the batch: its bar, the key's first
    reason for rejection and the ticker's (``ticker_reason``).

    Reasons: a null (or NaN) field, a key repeated in the batch, a
    non-positive price, High below Low. One aggregate per key, then one
    window per ticker (bounded by its days); rows without a Ticker stand for
    themselves, so they cannot gather in one task.
    """
    rows = conform(batch)
    price_ok = (F.col("Open") > 0) & (F.col("High") > 0) & (F.col("Low") > 0) & (F.col("Close") > 0)
    nulls = F.lit(False)
    for c in BAR_COLUMNS:
        nulls = nulls | F.col(c).isNull()
    per_row = F.when(nulls, F.lit("null field")) \
        .when(~price_ok, F.lit("non-positive price")) \
        .when(F.col("High") < F.col("Low"), F.lit("high below low"))
    fields = [c for c in BAR_COLUMNS if c not in KEY]
    keyed = rows.withColumn("reason", per_row).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("reason").alias("reason"), *[F.first(c).alias(c) for c in fields])
    dup = F.when((F.col("n") > 1) & F.col("Ticker").isNotNull() & F.col("Date").isNotNull(), F.lit("duplicate key"))
    keyed = keyed.withColumn("reason", F.least(F.col("reason"), dup))
    spread = F.when(F.col("Ticker").isNull(), F.col("Date"))
    return keyed.withColumn("ticker_reason", F.min("reason").over(Window.partitionBy("Ticker", spread)))


def split_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted bars, rejected tickers with reason). A bad ticker does not
    stop the others; rows without a Ticker are rejected under a null ticker."""
    rows = checked(batch)
    accepted = rows.where("ticker_reason is null").select(*BAR_COLUMNS)
    bad = rows.where("reason is not null").groupBy("Ticker").agg(F.min("reason").alias("reason"))
    return accepted, bad
