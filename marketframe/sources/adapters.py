"""Turn trade-like rows (ticks) into daily bars.

A bar is one row per (Ticker, Date): first, highest, lowest and last price of
the day and a volume. The aggregation is a plain ``groupBy`` with map-side
partial aggregation, so a ticker that holds a large share of all ticks is
reduced to at most one row per day and map task before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform


def ticks_to_bars(ticks: DataFrame, *, ticker: Column, day: Column, price: Column,
                  order: Column, volume: Column | None = None) -> DataFrame:
    """Daily OHLCV from ticks.

    ``order`` fixes which tick is first/last within a day; it must be unique
    within (ticker, day) or include the price, so that open/close do not
    depend on the order rows arrive in. ``volume`` is summed; without it the
    bar volume is the tick count.
    """
    t = ticks.select(
        ticker.cast("string").alias("Ticker"),
        day.cast("date").alias("Date"),
        price.cast("double").alias("_px"),
        order.alias("_ord"),
        (volume if volume is not None else F.lit(1)).alias("_vol"),
    )
    bars = t.groupBy("Ticker", "Date").agg(
        F.min_by("_px", "_ord").alias("Open"),
        F.max("_px").alias("High"),
        F.min("_px").alias("Low"),
        F.max_by("_px", "_ord").alias("Close"),
        F.sum("_vol").cast("bigint").alias("Volume"),
    )
    return conform(bars)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default bars: ticker = order priority, price = total price in whole cents."""
    o = read_table(spark, sf_dir, "orders")
    return ticks_to_bars(
        o,
        ticker=F.col("o_orderpriority"),
        day=F.col("o_orderdate"),
        price=F.round(F.col("o_totalprice") * 100),
        order=F.col("o_orderkey"),
    )


def line_order() -> Column:
    """Order of lines as one fixed-width number: order key, line number, unit
    price in millionths (the tie-break: the two keys can repeat). A decimal
    keeps min_by / max_by in hash aggregation, a struct would force a sort."""
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 1_000_000).cast("decimal(15,0)")
    return (F.col("l_orderkey").cast("decimal(19,0)") * F.lit(Decimal(10 ** 18)) + F.col("l_linenumber").cast("decimal(10,0)")
            * F.lit(Decimal(10 ** 15)) + price).cast("decimal(38,0)")


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More tickers: ticker = part brand, price = unit price of a line.

    part is joined by key; Spark broadcasts it only while its measured size
    stays under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run
    time) and falls back to a shuffle join beyond it. (l_orderkey,
    l_linenumber) is not unique in the data, hence the price in the order key.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return ticks_to_bars(
        j,
        ticker=F.col("p_brand"),
        day=F.col("l_shipdate"),
        price=px,
        order=line_order(),
        volume=F.col("l_quantity"),
    )


def bars_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: ticker = supplier and discount step, price = unit price."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return ticks_to_bars(
        li,
        ticker=F.concat(F.lit("S"), "l_suppkey", F.lit("/"), F.round(F.col("l_discount") * 100).cast("int")),
        day=F.col("l_shipdate"),
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        order=line_order(),
        volume=F.col("l_quantity"),
    )


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticks from the event log: ticker = event type, price = value."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("Ticker"),
        F.col("ts"),
        F.col("value").alias("Price"),
    )


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(
        ticks_from_events(spark, sf_dir),
        ticker=F.col("Ticker"), day=F.col("ts"), price=F.col("Price"), order=F.col("ts"),
    )


ADAPTERS = {
    "orders": bars_from_orders,
    "lineitem": bars_from_lineitem,
    "events": bars_from_events,
}
