"""Repeated incremental ingest as a Structured Streaming job.

Landed bar files (any format the bar schema can be read from) are picked up
by the file source; each micro-batch is validated and upserted into the bar
store, with the streaming checkpoint recording which files were processed.
``trigger(availableNow=True)`` processes what has landed and stops, which is
the shape of a daily job; a scheduler decides when to launch it. Late or
corrected bars follow the table rule: the last write wins on (Ticker, Date),
by the modification time of the landed file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..schema import BAR_COLUMNS, OHLCV
from ..sources.store import BarStore


def landed_bars(spark: SparkSession, landing: str, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(OHLCV).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(landing)


def resolve(batch: DataFrame) -> DataFrame:
    """Bars of a micro-batch with one landing per key: of several files that
    hold a key, the one modified last wins (ties: the greater path). A key
    repeated inside the winning file stays repeated, for the check to reject."""
    w = Window.partitionBy("Ticker", "Date")
    landed = F.struct(F.col("_landed"), F.col("_path"))
    return batch.withColumn("_last", F.max(landed).over(w)).where(landed == F.col("_last")).select(*BAR_COLUMNS)


def upsert_batch(store: BarStore, rejected_path: str):
    """foreachBatch handler: split good and bad tickers, upsert the good ones.

    The bars of rejected tickers go to ``rejected_path`` with the reason, by
    epoch: an epoch that runs again replaces its own rows.
    """
    def handle(batch: DataFrame, epoch_id: int) -> None:
        rows = resolve(batch)
        accepted, rejected = I.split_batch(rows)
        store.upsert(accepted)
        bars = rows.join(rejected, rows["Ticker"].eqNullSafe(rejected["Ticker"])).drop(rejected["Ticker"])
        bars.write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch_id}")
    return handle


def run_available(spark: SparkSession, landing: str, store_path: str, checkpoint: str,
                  rejected_path: str, fmt: str = "parquet", store: BarStore | None = None) -> None:
    """Process every landed file not yet seen, then stop."""
    store = store or BarStore(spark, store_path)
    store.initialize()
    landed = landed_bars(spark, landing, fmt).select(
        *BAR_COLUMNS, F.col("_metadata.file_modification_time").alias("_landed"), F.col("_metadata.file_path").alias("_path"))
    q = (landed.writeStream
         .foreachBatch(upsert_batch(store, rejected_path))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
