"""File system access of the driver for table metadata (the only JVM handles).

Small text files and existence checks go through Hadoop's FileSystem, so the
stores work wherever Spark can read and write. Data never passes here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """File names in a folder (none if it does not exist)."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file under a temporary name and rename it: readers see all of
    it or nothing. Raises ``FileExistsError`` if the name is taken."""
    import uuid
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _, part = _fs(spark, f"{p.getParent().toString()}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(part, p):
        raise FileExistsError(path)
