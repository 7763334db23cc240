"""Spark session settings the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the package assumes (see README, "Session").
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Two window outputs partitioned by Ticker can be joined on (Ticker, x)
    # without a second exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Upserts replace only the Ticker partitions they touch.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows travel to Python workers in batches of bounded size, whatever a row holds;
    # the JVM and the worker of every running task hold such batches, outside the heap.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
    # Broadcast is decided by size: 10 MB is Spark's default bound, stated here
    # so that it is a checked limit of ours and not an accident.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings to an existing session and make
    the package importable on the executors."""
    for key, value in ENGINE_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf on a running session: keep what is set
            pass
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``).

    Tasks that run package code (pandas features, the grouped least-squares
    solve) unpickle functions by module name, so the Python workers must be
    able to import ``marketframe`` wherever the driver was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="marketframe-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, files in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "marketframe") -> SparkSession:
    """Session for tests and local benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MF_DRIVER_MEMORY", "8g"))
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    It must be storage that the driver and all executors share. With the
    setting absent there is no such folder to choose: that is an error on a
    cluster. In local mode, where driver and executors are one process, a
    scratch folder is made.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="mf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint directory of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Evaluate ``df`` once into the shared folder and read it back: later steps
    start from the files, which outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
