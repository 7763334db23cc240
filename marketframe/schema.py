"""Bar schema and its validation.

Spark does not enforce NOT NULL or keys on files, so validation is a query:
it returns the offending rows instead of raising half-way through a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("Ticker", "Date")
PRICE_COLUMNS = ("Open", "High", "Low", "Close")
OHLCV_COLUMNS = ("Open", "High", "Low", "Close", "Volume")
BAR_COLUMNS = ("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")

OHLCV = T.StructType([
    T.StructField("Date", T.DateType(), False),
    T.StructField("Ticker", T.StringType(), False),
    T.StructField("Open", T.DoubleType(), False),
    T.StructField("High", T.DoubleType(), False),
    T.StructField("Low", T.DoubleType(), False),
    T.StructField("Close", T.DoubleType(), False),
    T.StructField("Volume", T.LongType(), False),
])

_CASTS = {f.name: f.dataType for f in OHLCV.fields}


def require_columns(df: DataFrame, columns=OHLCV_COLUMNS) -> None:
    """Raise ``ValueError`` naming the columns that are absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {set(missing)}")


def conform(df: DataFrame) -> DataFrame:
    """Project and cast to the canonical bar schema (column order fixed). NaN is
    no price: it becomes null, so that every later check sees a missing field."""
    require_columns(df, BAR_COLUMNS)
    return df.select(*[(null_if_nan(F.col(c).cast(_CASTS[c])) if c in PRICE_COLUMNS else F.col(c).cast(_CASTS[c])).alias(c)
                       for c in BAR_COLUMNS])


def violations(bars: DataFrame) -> DataFrame:
    """Rows that break the table contract, one row per (Ticker, Date, reason).

    Reasons: a null (or NaN) in a NOT NULL column, a duplicate (Ticker, Date) key.
    The duplicate check is an aggregation on the key, so it shuffles once on
    (Ticker, Date) with map-side partial counts; nothing goes to the driver.
    """
    bars = conform(bars)
    null_checks = [F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in BAR_COLUMNS]
    nulls = (
        bars.select("Ticker", "Date", F.array_compact(F.array(*null_checks)).alias("r"))
        .where(F.size("r") > 0)
        .select("Ticker", "Date", F.explode("r").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    )
    dups = (
        bars.groupBy("Ticker", "Date").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("Ticker", "Date", F.lit("duplicate key").alias("reason"), "n")
    )
    return nulls.unionByName(dups)


def null_if_nan(col: Column) -> Column:
    """Null instead of NaN (Spark treats NaN as larger than any number)."""
    return F.when(~F.isnan(col), col)
