"""Spark data source ``landed_bars``: vendor files that lie in one folder per ticker.

``spark.read.format("landed_bars").load(folder)`` reads
``folder/Ticker=<name>/*.parquet`` (bar columns, any order, dates as date or
timestamp) with one input partition per ticker. Predicates on Ticker choose the
folders before any file is opened; date bounds reach the file reader, which
skips row groups by statistics; all other predicates are left to Spark.
The folder must be one that driver and executors reach through pyarrow's file
systems (local or mounted paths, HDFS, S3); elsewhere Spark's own readers
(:mod:`.readers`) do the job.

Defined cases: a folder without files gives no rows, a missing column or a
missing folder is an error, a file without rows is nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
                                    LessThanOrEqual)

NAME = "landed_bars"
SCHEMA = "Date date, Ticker string, Open double, High double, Low double, Close double, Volume bigint"
_TYPES = {"Open": pa.float64(), "High": pa.float64(), "Low": pa.float64(), "Close": pa.float64(), "Volume": pa.int64()}
_PREFIX = "Ticker="
_BOUNDS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class TickerFolder(InputPartition):
    def __init__(self, ticker: str, path: str):
        super().__init__(ticker)
        self.ticker, self.path = ticker, path


class LandedReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.tickers: set[str] | None = None
        self.bounds: list[tuple[str, dt.date]] = []

    def _files(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take ticker and date predicates, give back the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("Ticker",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = named if self.tickers is None else self.tickers & named
            elif column == ("Date",) and type(f) in _BOUNDS and isinstance(f.value, dt.date):
                self.bounds.append((_BOUNDS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[TickerFolder]:
        from pyarrow import fs
        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(root))
        folders = [(unquote(i.base_name[len(_PREFIX):]), i.path) for i in found if i.type == fs.FileType.Directory and i.base_name.startswith(_PREFIX)]
        return [TickerFolder(t, p) for t, p in sorted(folders) if self.tickers is None or t in self.tickers]

    def read(self, partition: TickerFolder) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs
        files, _ = self._files()
        names = sorted(i.path for i in files.get_file_info(fs.FileSelector(partition.path)) if i.path.endswith(".parquet"))
        if not names:
            return
        data = ds.dataset(names, filesystem=files, format="parquet")
        kind = data.schema.field("Date").type
        keep = None
        for op, day in self.bounds:
            # a day bounds dates as it is, timestamps by its midnights
            limit = day if pa.types.is_date(kind) else dt.datetime.combine(day + dt.timedelta(days=op in (">", "<=")), dt.time())
            op = op if pa.types.is_date(kind) else {">": ">=", "<=": "<"}.get(op, op)
            value, date = pa.scalar(limit, kind), pc.field("Date")
            one = {">": date > value, ">=": date >= value, "<": date < value, "<=": date <= value}[op]
            keep = one if keep is None else keep & one
        for b in data.to_batches(columns=["Date", *_TYPES], filter=keep):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b["Date"].cast(pa.date32()), pa.array([partition.ticker] * b.num_rows), *(b[c].cast(t) for c, t in _TYPES.items())],
                    names=["Date", "Ticker", *_TYPES])


class LandedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicates pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedBars)
