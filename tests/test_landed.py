"""The data source for landed files: partitions, pushed predicates, defined cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from market_fixtures import ramp
from marketframe.sources import landed


@pytest.fixture()
def folder(spark, tmp):
    root = f"{tmp}/landing"
    bars = ramp(spark, 40, "A").union(ramp(spark, 40, "B", base=5.0)).union(ramp(spark, 3, "C/1"))
    bars.withColumn("Date", F.col("Date").cast("timestamp_ntz")).write.partitionBy("Ticker").parquet(root)
    return root


def test_predicates_reach_the_reader(folder):
    r = landed.LandedReader(folder)
    rest = list(r.pushFilters([In(("Ticker",), ("A", "Z")), IsNotNull(("Date",)), GreaterThanOrEqual(("Date",), dt.date(2024, 1, 10)),
                               LessThan(("Date",), dt.date(2024, 1, 12)), EqualTo(("Volume",), 3)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    [part] = r.partitions()
    assert part.ticker == "A"
    assert [str(d) for b in r.read(part) for d in b["Date"].to_pylist()] == ["2024-01-10", "2024-01-11"]


def test_one_partition_per_ticker_and_the_rows_of_the_files(spark, folder):
    landed.register(spark)
    df = spark.read.format(landed.NAME).load(folder)
    assert df.rdd.getNumPartitions() == 3
    assert {r.Ticker: r["count"] for r in df.groupBy("Ticker").count().collect()} == {"A": 40, "B": 40, "C/1": 3}
    got = df.where("Ticker = 'B' and Date >= date'2024-02-01' and Date <= date'2024-02-03' and Close > 37").collect()
    assert [(str(r.Date), r.Close) for r in sorted(got)] == [("2024-02-03", 38.0)]
    assert landed.LandedReader(folder).tickers is None


def test_empty_and_missing_folders(spark, tmp):
    import os
    os.makedirs(f"{tmp}/none/Ticker=X")
    landed.register(spark)
    assert spark.read.format(landed.NAME).load(f"{tmp}/none").collect() == []
    with pytest.raises(Exception, match="absent"):
        spark.read.format(landed.NAME).load(f"{tmp}/absent").collect()
