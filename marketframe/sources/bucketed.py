"""Tables bucketed by ticker in the catalog: windows and joins on Ticker need no exchange.

``bucketBy`` records in the catalog that a table's files are hash-partitioned by
Ticker and sorted by (Ticker, Date) inside. Two tables with the same number of
buckets are co-located: their join on (Ticker, Date), and every window
partitioned by Ticker above them, reads bucket by bucket. Choose the number of
buckets by the size of the bars (about 128 MB each), once for all tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BUCKETS = 16


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as a bucketed catalog table at ``path`` and return the table.

    The rows are dealt by the same hash as the buckets first, so that each
    bucket is one file instead of one per task.
    """
    (df.repartition(buckets, "Ticker").write.format("parquet").option("path", path)
     .bucketBy(buckets, "Ticker").sortBy("Ticker", "Date").saveAsTable(table))
    return df.sparkSession.table(table)
