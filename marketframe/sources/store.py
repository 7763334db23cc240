"""Stored tables: bars (S5-S10), feature store (S12), runs and models.

``VersionedTable`` keeps rows in folders by hash bucket of the ticker and by
period of the date (month or year); bucket count and period are recorded when
the table is created. A write puts the new content of the folders that it
touches under a new version and then publishes a manifest that names the
version of every folder. Readers use the newest manifest, so a write that fails
or is repeated midway changes nothing, and a reader never sees a mix. A second
writer that started from the same manifest fails when it publishes.

A daily batch rewrites the current period of its buckets only, and a read lists
only the folders of the tickers and dates it asks for. The driver handles one
manifest entry per folder (buckets x periods), never rows or ticker lists.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bars as B
from ..schema import BAR_COLUMNS, OHLCV, conform, require_columns
from ..session import written
from . import files
from .readers import date_range

BUCKETS = 16
PERIODS = {"month": "yyyy-MM", "year": "yyyy"}


class VersionedTable:
    """Rows keyed by ``key`` (which holds Ticker and Date) in bucket x period folders."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Iterable[str],
                 buckets: int = BUCKETS, period: str = "month") -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        self.layout = {"buckets": buckets, "period": period}

    # -- manifests --
    def _latest(self) -> tuple[int, dict]:
        """(number, manifest) of the newest version; number 0 before the first."""
        have = [int(n[:-5]) for n in files.names(self.spark, f"{self.path}/manifests") if n[:-5].isdigit()]
        if not have:
            return 0, {"layout": self.layout, "folders": {}}
        top = max(have)
        return top, json.loads(files.read_text(self.spark, f"{self.path}/manifests/{top:010d}.json"))

    def _publish(self, number: int, manifest: dict) -> None:
        try:
            files.create_text(self.spark, f"{self.path}/manifests/{number:010d}.json", json.dumps(manifest))
        except FileExistsError as e:
            raise RuntimeError(f"{self.path}: another writer published version {number} first") from e

    def create(self) -> None:
        number, manifest = self._latest()
        if number == 0:
            self._publish(1, manifest)

    # -- layout --
    def _placed(self, df: DataFrame, layout: dict) -> DataFrame:
        return (df.withColumn("bucket", F.pmod(F.xxhash64("Ticker"), F.lit(layout["buckets"])).cast("int"))
                .withColumn("period", F.date_format("Date", PERIODS[layout["period"]])))

    def _buckets_of(self, tickers: Iterable[str], layout: dict) -> set[int]:
        """Buckets of the tickers a caller names: literals that the optimizer folds,
        so no job runs."""
        named = list(dict.fromkeys(tickers))
        if not named:
            return set()
        bucket = [F.pmod(F.xxhash64(F.lit(t)), F.lit(layout["buckets"])).cast("int") for t in named]
        return set(self.spark.sql("SELECT 1").select(F.array(*bucket).alias("b")).first()["b"])

    def _read_folders(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{version}/{folder}" for folder, version in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The table, or the part that the tickers and the inclusive dates need;
        folders without such rows are not listed, files are pruned by statistics."""
        _, manifest = self._latest()
        folders, layout = manifest["folders"], manifest["layout"]
        size = 7 if layout["period"] == "month" else 4
        if tickers is not None:
            tickers = [tickers] if isinstance(tickers, str) else list(tickers)
            wanted = self._buckets_of(tickers, layout)
            folders = {f: v for f, v in folders.items() if int(f.split("/")[0].split("=")[1]) in wanted}
        if start is not None or end is not None:
            lo, hi = (start or "")[:size], (end or "9999-99-99")[:size]
            folders = {f: v for f, v in folders.items() if lo <= f.split("period=")[1] <= hi}
        df = self._read_folders(folders)
        if tickers is not None:
            df = df.where(F.col("Ticker").isin(tickers))
        return date_range(df, start, end)

    def newest(self, n: int, wanted: DataFrame) -> DataFrame:
        """The last ``n`` rows of every wanted ticker before its day ``before``
        (null: of all days), found from the newest period back.

        ``wanted`` is (Ticker, before). Each step reads twice as many periods as
        the one before and asks only for the tickers that still lack rows, so
        tickers that trade every day cost the newest folders, and one that
        stopped years ago is found further back. Reading ends when nobody lacks
        rows or no folder is left.
        """
        _, manifest = self._latest()
        by_period: dict[str, dict[str, str]] = {}
        for folder, version in manifest["folders"].items():
            by_period.setdefault(folder.split("period=")[1], {})[folder] = version
        periods, size, found = sorted(by_period, reverse=True), 1, None
        open_ = written(wanted.select("Ticker", F.col("before").cast("date").alias("before"), F.lit(n).cast("long").alias("need")), "wanted")
        if open_.where("before is null").isEmpty():  # later periods hold nothing that is asked for
            top = open_.agg(F.date_format(F.max("before"), PERIODS[manifest["layout"]["period"]]).alias("p")).first()["p"]
            periods = [p for p in periods if top is not None and p <= top]
        newest_first = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
        while periods:
            part, periods = periods[:size], periods[size:]
            size *= 2
            rows = self._read_folders({f: v for p in part for f, v in by_period[p].items()})
            rows = (rows.join(open_, "Ticker").where("before is null or Date < before")
                    .withColumn("_rk", F.row_number().over(newest_first)).where("_rk <= need").select(*self.schema.names))
            rows = written(rows, "newest")
            found = rows if found is None else found.unionByName(rows)
            got = rows.groupBy("Ticker").agg(F.count(F.lit(1)).alias("got"))
            left = open_.join(got, "Ticker", "left").select("Ticker", "before", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"))
            open_ = written(left.where("need > 0"), "wanted")
            if open_.isEmpty():
                break
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def _rewrite(self, number: int, manifest: dict, rows: DataFrame, touched: Iterable[str]) -> None:
        """Publish ``rows`` as the whole content of the touched folders."""
        layout, version = manifest["layout"], f"{number + 1:010d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/data/{version}"
        # as many files a folder as keep every task of the session busy, dealt by ticker
        # and sorted by key, so that statistics prune tickers and dates
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files_each = max(1, tasks // max(1, len(set(touched))))
        deal = F.pmod(F.xxhash64("Ticker", F.lit("file")), F.lit(files_each))
        (self._placed(rows, layout).repartition(tasks, "bucket", "period", deal).sortWithinPartitions("bucket", "period", *self.key)
         .write.partitionBy("bucket", "period").parquet(target))
        buckets = [n for n in files.names(self.spark, target) if n.startswith("bucket=")]
        written = {f"{b}/{p}" for b in buckets for p in files.names(self.spark, f"{target}/{b}") if p.startswith("period=")}
        folders = {f: v for f, v in manifest["folders"].items() if f not in set(touched)}
        folders.update(dict.fromkeys(written, version))
        self._publish(number + 1, {"layout": layout, "folders": folders})

    def upsert(self, batch: DataFrame) -> int:
        """Replace the keys present in ``batch``, insert the rest; returns its rows.

        The batch is evaluated once, into a staging folder of the table. One
        aggregate over it gives rows, repeated keys and touched folders. A null
        key or a repeated key is rejected before anything is published.
        """
        number, manifest = self._latest()
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(staging)
        new = self.spark.read.schema(self.schema).parquet(staging)
        per_key = self._placed(new, manifest["layout"]).groupBy("bucket", "period", *self.key).agg(F.count("*").alias("n"))
        empty_key = F.greatest(*[F.col(k).isNull().cast("int") for k in self.key])
        found = per_key.groupBy("bucket", "period").agg(F.sum("n").alias("rows"), F.max("n").alias("most"),
                                                        F.max(empty_key).alias("no_key")).collect()
        if not found:
            return 0
        if any(r["no_key"] for r in found):
            raise ValueError(f"null in key ({', '.join(self.key)})")
        if any(r["most"] > 1 for r in found):
            raise ValueError(f"duplicate ({', '.join(self.key)}) keys in batch")
        touched = [f"bucket={r['bucket']}/period={r['period']}" for r in found]
        old = self._read_folders({f: v for f, v in manifest["folders"].items() if f in set(touched)})
        self._rewrite(number, manifest, old.join(new.select(*self.key), self.key, "left_anti").unionByName(new), touched)
        return sum(r["rows"] for r in found)

    def delete(self, tickers: Iterable[str]) -> None:
        """Remove all rows of the tickers: their buckets are rewritten without them."""
        tickers = [tickers] if isinstance(tickers, str) else list(tickers)
        number, manifest = self._latest()
        wanted = self._buckets_of(tickers, manifest["layout"])
        touched = {f: v for f, v in manifest["folders"].items() if int(f.split("/")[0].split("=")[1]) in wanted}
        if touched:
            kept = self._read_folders(touched).where(F.col("Ticker").isNull() | ~F.col("Ticker").isin(tickers))
            self._rewrite(number, manifest, kept, touched)

    def clear(self) -> None:
        number, manifest = self._latest()
        self._publish(number + 1, {"layout": manifest["layout"], "folders": {}})


class BarStore:
    """OHLCV table keyed by (Ticker, Date)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, period: str = "month") -> None:
        self.spark = spark
        self.path = path
        self.table = VersionedTable(spark, path, OHLCV, ("Ticker", "Date"), buckets, period)

    def initialize(self) -> None:
        """Create the (empty) table with the canonical schema if absent."""
        self.table.create()

    def read(self) -> DataFrame:
        return self.table.read().select(*BAR_COLUMNS)

    def upsert(self, batch: DataFrame) -> int:
        """Replace (Ticker, Date) keys present in ``batch``, insert the rest.

        Missing columns raise ``ValueError``; an empty batch returns 0; a key
        that is null or repeated inside the batch is rejected. Returns the
        number of batch rows.
        """
        require_columns(batch, BAR_COLUMNS)
        return self.table.upsert(conform(batch))

    def scan(self, tickers=None, start=None, end=None) -> DataFrame:
        return self.table.read(tickers, start, end).select(*BAR_COLUMNS).orderBy("Ticker", "Date")

    def _wanted(self, tickers: Iterable[str] | None) -> DataFrame:
        """(Ticker, before = null): the named tickers, else all (their column alone is read)."""
        if tickers is None:
            named = self.tickers()
        else:
            named = self.spark.createDataFrame([(t,) for t in dict.fromkeys([tickers] if isinstance(tickers, str) else tickers)], "Ticker string")
        return named.select("Ticker", F.lit(None).cast("date").alias("before"))

    def latest_date(self, tickers: Iterable[str] | None = None) -> DataFrame:
        """Of the named tickers (read from the newest period back) or of all."""
        return B.latest_date(self.read() if tickers is None else self.table.newest(1, self._wanted(tickers)))

    def tickers(self) -> DataFrame:
        return B.tickers(self.read())

    def latest_bars(self, n: int = 1, tickers: Iterable[str] | None = None) -> DataFrame:
        """The last n bars of the named tickers or of all, from the newest period back."""
        return self.table.newest(n, self._wanted(tickers)).select(*BAR_COLUMNS)


# ---- feature store -----------------------------------------------------------------------------

FEATURE_ROW = T.StructType([
    T.StructField("Ticker", T.StringType(), False),
    T.StructField("Date", T.DateType(), False),
    T.StructField("feature", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("computed_at", T.TimestampType(), True),
    T.StructField("source_max_date", T.DateType(), True),
])


def to_long(features: DataFrame, computed_at: dt.datetime | None = None) -> DataFrame:
    """Wide feature frame -> long rows (Ticker, Date, feature, value, computed_at)."""
    names = [c for c in features.columns if c not in ("Ticker", "Date")]
    ts = F.lit(computed_at) if computed_at is not None else F.current_timestamp()
    # latest bar the features were computed from (per ticker): lets a reader
    # see that bars were upserted after the features were stored. Taken on the wide
    # rows, which are partitioned by ticker already where features come from windows
    src_max = F.max("Date").over(Window.partitionBy("Ticker"))
    wide = features.select("Ticker", "Date", src_max.alias("source_max_date"), *[F.col(c).cast("double").alias(c) for c in names])
    long = wide.unpivot(["Ticker", "Date", "source_max_date"], names, "feature", "value")
    return long.select("Ticker", "Date", "feature", "value", ts.cast("timestamp").alias("computed_at"), "source_max_date")


def to_wide(long: DataFrame, names: Iterable[str]) -> DataFrame:
    """Long rows -> Date, Ticker, one column per name (pivot with the values listed,
    so Spark needs no extra pass to discover them)."""
    names = list(names)
    return long.groupBy("Ticker", "Date").pivot("feature", names).agg(F.first("value")) \
        .select("Date", "Ticker", *names)


class FeatureStore:
    """S12 on a long-form table keyed by (Ticker, Date, feature).

    set = upsert; get = scan of the asked folders + pivot; exists = a probe;
    delete = rewrite the ticker's bucket without it; clear = an empty version.
    TTL is a predicate on ``computed_at``.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int | None = 86400, buckets: int = BUCKETS,
                 period: str = "month") -> None:
        self.spark, self.path, self.ttl = spark, path, ttl_seconds
        self.table = VersionedTable(spark, path, FEATURE_ROW, ("Ticker", "Date", "feature"), buckets, period)

    def _fresh(self, df: DataFrame, as_of: dt.datetime | None) -> DataFrame:
        if self.ttl is None:
            return df
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        return df.where(F.col("computed_at") >= now - F.expr(f"INTERVAL {int(self.ttl)} SECONDS"))

    def rows(self, as_of: dt.datetime | None = None) -> DataFrame:
        """The stored long rows that have not expired."""
        return self._fresh(self.table.read(), as_of)

    def set(self, features: DataFrame, computed_at: dt.datetime | None = None) -> None:
        self.table.upsert(to_long(features, computed_at))

    def get(self, tickers: Iterable[str] | None, names: Iterable[str], start: str | None = None,
            end: str | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        names = list(names)
        df = self._fresh(self.table.read(tickers, start, end), as_of).where(F.col("feature").isin(names))
        return to_wide(df, names)

    def stale(self, latest: DataFrame) -> DataFrame:
        """Tickers whose stored features predate their bars.

        ``latest`` is (Ticker, latest_date), e.g. ``BarStore.latest_date()``.
        A ticker is stale when nothing is stored for it or its newest bar is
        after the ``source_max_date`` recorded with its features.
        """
        stored = self.table.read().groupBy("Ticker").agg(F.max("source_max_date").alias("source_max_date"))
        j = latest.join(stored, "Ticker", "left")
        return j.where(F.col("source_max_date").isNull() | (F.col("latest_date") > F.col("source_max_date"))) \
            .select("Ticker", "latest_date", "source_max_date")

    def exists(self, ticker: str, names: Iterable[str], as_of: dt.datetime | None = None) -> bool:
        names = list(names)
        df = self._fresh(self.table.read(ticker), as_of).where(F.col("feature").isin(names))
        have = df.select("feature").distinct()
        want = self.spark.createDataFrame([(n,) for n in names], "feature string")
        return want.join(have, "feature", "left_anti").isEmpty()

    def delete(self, ticker: str) -> None:
        self.table.delete([ticker])

    def clear(self) -> None:
        self.table.clear()


# ---- runs and models ------------------------------------------------------------------------------

RUN_ROW = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_name", T.StringType(), True),
    T.StructField("experiment", T.StringType(), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("features", T.ArrayType(T.StringType()), True),
    T.StructField("model_path", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])


class RunLog:
    """One row per training run in a Parquet table; models saved with
    pyspark.ml persistence under ``<root>/models/<run_id>``."""

    def __init__(self, spark: SparkSession, root: str, experiment: str = "default") -> None:
        self.spark, self.root, self.experiment = spark, root, experiment

    @property
    def table(self) -> str:
        return f"{self.root}/runs"

    def new_run_id(self) -> str:
        return uuid.uuid4().hex

    def model_path(self, run_id: str) -> str:
        return f"{self.root}/models/{run_id}"

    def log(self, run_id: str, run_name: str, params: dict, metrics: dict, model=None,
            features: Iterable[str] = ()) -> None:
        path = None
        if model is not None:
            path = self.model_path(run_id)
            model.write().overwrite().save(path)
        row = (run_id, run_name, self.experiment, {k: str(v) for k, v in params.items()},
               {k: float(v) for k, v in metrics.items()}, list(features), path, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([row], RUN_ROW).write.mode("append").parquet(self.table)

    def runs(self) -> DataFrame:
        if not files.exists(self.spark, self.table):
            return self.spark.createDataFrame([], RUN_ROW)
        return self.spark.read.schema(RUN_ROW).parquet(self.table)

    def run(self, run_id: str) -> dict:
        """One run as a dict (a single small row)."""
        rows = self.runs().where(F.col("run_id") == run_id).take(1)
        if not rows:
            raise ValueError(f"Run not found: {run_id}")
        return rows[0].asDict()

    def load_model(self, run_id: str):
        from pyspark.ml import PipelineModel
        path = self.model_path(run_id)
        if not files.exists(self.spark, path):
            raise ValueError(f"Model not found for run: {run_id}")
        return PipelineModel.load(path)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Run id, name, test R² and RMSE, best R² first."""
    return runs.select("run_id", "run_name", F.col("metrics")["test_r2"].alias("test_r2"),
                       F.col("metrics")["test_rmse"].alias("test_rmse")).orderBy(F.col("test_r2").desc_nulls_last())

