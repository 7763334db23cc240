"""Scoring (P1-P5): predictions dated by business day, latest-N per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def business_day_shift(d: Column, n: int | Column) -> Column:
    """D + n business days (Mon-Fri, no holidays); n = 0 leaves d unchanged.

    A weekend date first rolls back to Friday's position in its week (as a
    business-day offset does) and then moves n weekdays forward.
    """
    n = F.lit(n) if isinstance(n, int) else n
    wd = F.weekday(d)                       # Monday = 0 ... Sunday = 6
    k = F.least(wd, F.lit(4)) + n           # weekday position after moving n days
    monday = F.date_sub(d, wd)
    shifted = F.date_add(monday, (F.floor(k / 5) * 7 + F.pmod(k, F.lit(5))).cast("int"))
    return F.when(n == 0, d).otherwise(shifted)


def dated_predictions(scored: DataFrame, lookback: int = 1) -> DataFrame:
    """(prediction, Date = feature date + lookback business days, feature_date, Ticker)."""
    return scored.select(
        F.col("prediction"),
        business_day_shift(F.col("Date"), lookback).alias("Date"),
        F.col("Date").alias("feature_date"),
        F.col("Ticker"),
    )


def latest(predictions: DataFrame, n: int = 1, date_col: str = "feature_date") -> DataFrame:
    """P5: last n predictions of every ticker (by feature date)."""
    w = Window.partitionBy("Ticker").orderBy(F.col(date_col).desc())
    return predictions.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
