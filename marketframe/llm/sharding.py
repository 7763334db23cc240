"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is the first 64 bits of an MD5 over its id and text. A shard
is a bucket of all keys with one bit prefix; its local depth is the length of
that prefix. The directory starts with one bucket. While a bucket holds more
than the byte limit it alone is split on its next bit.

Splits are found from byte histograms: documents of oversized buckets are
summed by their next ``STEP`` bits (partial sums before the shuffle, at most
2^STEP rows per bucket), every bit of that histogram is folded into the bytes
of all shorter prefixes, and a cell's bucket is its shortest prefix that fits.
Buckets that still do not fit take part in another round of ``STEP`` bits.

A bucket whose documents all have one key cannot be split. If it is over the
limit (a document larger than the limit, or the same row many times) it keeps
the shortest prefix that holds this key alone, and its equal rows go to
overflow pages of as many rows as fit (one at least).

Defined cases: null and empty texts have 0 bytes and are placed by their key;
a null doc_id is part of the key as such; repeated rows share a key; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import stored, table

LIMIT_BYTES = 64 * 1024 * 1024
STEP = 12
BITS = 64

KEY = ("lpad(conv(substr(md5(concat(coalesce(cast(doc_id as string), 'null'), '|', coalesce(text, ''))), 1, 16), 16, 2), 64, '0')")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page) of every document. ``shard`` is the
    bit prefix of the bucket, ``depth`` its length, ``page`` the overflow page."""
    keyed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                           F.expr(KEY).alias("key")), "keys")
    waiting, done = keyed, None
    for base in range(0, BITS, STEP):
        top = min(base + STEP, BITS)
        cells = (waiting.groupBy(F.substring("key", 1, top).alias("cell"))
                 .agg(F.sum("n_bytes").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")))
        levels = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        prefix = F.expr("substr(cell, 1, depth)")
        sums = (levels.groupBy("depth", prefix.alias("prefix"))
                .agg(F.sum("bytes").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .where(f"total <= {limit} or lo = hi").select("depth", "prefix", "total"))
        fit = (levels.select("cell", "depth", prefix.alias("prefix")).join(sums, ["depth", "prefix"])
               .groupBy("cell").agg(F.min(F.struct("depth", "prefix", "total")).alias("b")))
        # the first round has 2 ** STEP cells at most, whatever the documents are: these, never
        # the documents' keys, are the broadcast side; later rounds have as many a full bucket
        found = cells.select("cell").join(fit, "cell", "left")
        found = F.broadcast(found) if base == 0 else found.hint("merge")
        placed = stored(waiting.join(found, F.substring("key", 1, top) == F.col("cell"))
                        .select("doc_id", "n_bytes", "key", F.col("b.prefix").alias("shard"), F.col("b.depth").alias("depth"),
                                F.col("b.total").alias("total")), "placed")
        ready = placed.where("shard is not null")
        done = ready if done is None else done.union(ready)
        waiting = placed.where("shard is null").select("doc_id", "n_bytes", "key")
        if waiting.isEmpty():
            break
    plain = done.where(f"total <= {limit}").select("doc_id", "n_bytes", "shard", "depth", F.lit(0).cast("long").alias("page"))
    # buckets of one key: equal rows are counted, then dealt to pages by number
    alike = done.where(f"total > {limit}").groupBy("doc_id", "n_bytes", "key", "shard", "depth").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("pages").over(Window.partitionBy("shard").orderBy("doc_id", "n_bytes")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alike = (alike.withColumn("fit", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))))
             .withColumn("pages", F.ceil(F.col("rows") / F.col("fit"))).withColumn("before", before)
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
             .select("doc_id", "n_bytes", "shard", "depth", (F.col("before") + F.floor(F.col("i") / F.col("fit"))).cast("long").alias("page")))
    return plain.union(alike)


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard page: shard, depth, page, documents and bytes."""
    return assigned.groupBy("shard", "depth", "page").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def oracle_sql(limit: int = LIMIT_BYTES, source: str = "documents") -> str:
    """DuckDB statement for ``shards`` (equal rows in one over-full bucket go
    to pages by row number, which is the same as by count)."""
    return f"""
WITH keyed AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '|', coalesce(text, ''))), 1, 16) AS UBIGINT)), 64, '0') AS key
  FROM {source}),
sized AS (SELECT key, sum(n_bytes) AS bytes FROM keyed GROUP BY key),
levels AS (SELECT key, d AS depth, substr(key, 1, CAST(d AS INT)) AS prefix, bytes FROM sized, range(0, 65) r(d)),
sums AS (SELECT depth, prefix, sum(bytes) AS total FROM levels GROUP BY depth, prefix
         HAVING sum(bytes) <= {limit} OR min(key) = max(key)),
fit AS (SELECT l.key, min(l.depth) AS depth FROM levels l JOIN sums s ON l.depth = s.depth AND l.prefix = s.prefix GROUP BY l.key),
rows_ AS (SELECT k.doc_id, k.n_bytes, k.key, f.depth, substr(k.key, 1, CAST(f.depth AS INT)) AS shard,
                 sum(k.n_bytes) OVER (PARTITION BY k.key) AS own,
                 row_number() OVER (PARTITION BY k.key, k.doc_id, k.n_bytes) - 1 AS i
          FROM keyed k JOIN fit f ON k.key = f.key)
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth,
       CASE WHEN own <= {limit} THEN CAST(0 AS BIGINT)
            ELSE CAST(i // greatest(1, {limit} // greatest(n_bytes, 1)) AS BIGINT) END AS page
FROM rows_"""
