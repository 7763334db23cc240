"""Target-distribution importance resampling: documents are drawn in proportion to
how much likelier their words are in a target corpus than in their own.

Weights. Features are runs of 1 to ``longest`` words (lower case A-Z, letters,
digits and everything beyond ASCII), hashed by crc32 into ``buckets``. One scan
counts the buckets of the documents, one those of the target; the gains of all
buckets form one array (a fixed number of longs) that every task holds, and a
document's weight is the sum of its features' gains. A Gumbel number per
document, taken from a digest of its id, is added: the highest scores are a
draw without replacement in proportion to the weights.

Order. Rows are ranked by a distributed least-significant-digit radix sort on the
composite key (score descending, doc_id ascending, null ids last). Rows have
places and lie in blocks of consecutive places. Each pass takes one digit of
the key: blocks count their digits, prefix sums over (digit, block) give every
block the first place of each of its digits, and a stable counting sort in the
block gives each row its destination. After the last digit the places are the
ranks. Blocks hold a set number of rows whatever the keys are, so equal or
frequent keys fill no task. Only the totals of the digits (at most
2 ** DIGIT_BITS numbers) reach the driver.

Defined cases: null and empty texts have no feature, weight 0 and are not drawn;
a null doc_id is spelled as an empty text in the digest; rows that are equal in
score and id rank in the order of the input's rows; fewer than 100 / percent
eligible documents draw none; an empty target gives every bucket the smoothed
share; an empty table gives no rows; other columns are ignored, also such with
names that are used here.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import LOWER, Texts, byte_class, parallelism, runs, stored, table, text_blocks, tidy

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
DIGIT_BITS = 14
BLOCK_ROWS = 1 << 18  # rows that a block holds at most

_WORD = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
_LONG = 64  # spans from this many bytes on go to zlib one by one


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned crc32 of every span, going on from the values of ``before``."""
    value = np.zeros(len(start), np.uint32) if before is None else before.copy()
    size = end - start
    state = ~value
    todo = np.flatnonzero(size < _LONG)
    k = 0
    todo = todo[size[todo] > 0]
    while len(todo):
        c = state[todo]
        state[todo] = _CRC[(c ^ data[start[todo] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
        k += 1
        todo = todo[size[todo] > k]
    out = ~state
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(value[i]))
    return out


def features(block: Texts, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run length: (bucket, text index) of every feature, by text."""
    start, end, owner = runs(block, _WORD)
    data = LOWER[block.data]
    space = np.full(1, 0x20, np.uint8)
    crc = crc32_spans(data, start, end)
    yield crc.astype(np.int64) % buckets, owner
    for n in range(2, longest + 1):
        m = max(len(start) - n + 1, 0)
        crc = crc[:m]
        zero = np.zeros(m, np.int64)
        crc = crc32_spans(space, zero, zero + 1, crc)
        crc = crc32_spans(data, start[n - 1:], end[n - 1:], crc)
        whole = owner[:m] == owner[n - 1:]
        yield crc[whole].astype(np.int64) % buckets, owner[:m][whole]


def feature_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: ``buckets`` longs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                for bucket, _ in features(block, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(buckets, np.int64)
    for r in rows:
        total[r["bucket"]] = r["n"]
    return total


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares per bucket, in whole thousandths."""
    k, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(own.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "block long, at long, doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """Features, weight and score per document, with its place among the input's
    rows: partition and chunk of ``BLOCK_ROWS`` rows in it, row in the chunk."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            words, size, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for block in text_blocks(batch.column(1)):
                at = slice(block.first, block.first + len(block))
                for k, (bucket, owner) in enumerate(features(block, longest, buckets)):
                    cut = np.searchsorted(owner, np.arange(len(block) + 1))
                    total = np.concatenate([[0], np.cumsum(gain[bucket])])
                    weight[at] += total[cut[1:]] - total[cut[:-1]]
                    size[at] += np.diff(cut)
                    if k == 0:
                        words[at] = np.diff(cut)
            noise = np.array([gumbel(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            place = np.arange(seen, seen + n, dtype=np.int64)
            seen += n
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 32) + place // BLOCK_ROWS), pa.array(place % BLOCK_ROWS), batch.column(0),
                 pa.array(words), pa.array(size), pa.array(weight), pa.array(weight + noise)],
                names=["block", "at", "doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(tidy(score), SCORED)


def digits(keys: list[tuple[str, int]], width: int = DIGIT_BITS) -> list[tuple[str, int]]:
    """(expression of the digit, its bits) of a composite key, least significant
    first. Keys are (expression of a non-negative long, bits), least significant
    first; keys of no bits take no pass."""
    out = []
    for key, bits in keys:
        passes = -(-bits // width)
        for k in range(passes):
            low, high = k * bits // passes, (k + 1) * bits // passes
            out.append((f"cast(shiftrightunsigned({key}, {low}) & {(1 << high - low) - 1} as int)", high - low))
    return out


def counting_pass(rows: DataFrame, digit: str, bits: int, block_rows: int) -> DataFrame:
    """One stable pass: rows (block, at, ...) get the block and place that the
    order by (digit, block, at) gives them."""
    names = [c for c in rows.columns if c not in ("block", "at")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.withColumn("digit", F.expr(digit))
    counts = stored(keyed.groupBy("block", "digit").agg(F.count("*").alias("n")), "digit-counts")
    first = np.zeros(1 << bits, np.int64)
    for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():  # at most 2 ** bits rows
        first[r["digit"]] = r["n"]
    first = np.cumsum(first) - first
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))

    def place(block: pa.Table, offsets: pa.Table) -> pa.Table:
        block = block.take(pa.array(np.argsort(block["at"].to_numpy())))
        d = block["digit"].to_numpy().astype(np.int64)
        start = np.zeros(1 << bits, np.int64)
        own = offsets["digit"].to_numpy()
        start[own] = offsets["earlier"].to_numpy() + first[own]
        order = np.argsort(d, kind="stable")
        sorted_d = d[order]
        head = np.searchsorted(sorted_d, sorted_d)  # where the row's digit begins in the block
        to = np.empty(len(d), np.int64)
        to[order] = start[sorted_d] + np.arange(len(d)) - head
        return pa.table([pa.array(to // block_rows), pa.array(to % block_rows), *(block[c] for c in names)],
                        names=["block", "at", *names])

    ordered = "block long, at long" + "".join(f", {f}" for f in fields.split(", ")[2:])
    return (keyed.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(place, ordered))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, int]], n: int, blocks: int) -> DataFrame:
    """Rows (block, at, payload) with ``rank`` (from 1) by the keys, equal keys in
    the order of (block, at). ``n`` is the number of rows, ``blocks`` the least
    number of blocks to deal them to."""
    block_rows = max(1, min(BLOCK_ROWS, -(-n // max(blocks, 1))))
    todo = digits(keys) or [("0", 1)]
    for digit, bits in todo:
        rows = stored(counting_pass(rows, digit, bits, block_rows), "radix")
    return rows.withColumn("rank", F.expr(f"block * {block_rows} + at + 1")).drop("block", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null
    for documents that are not drawn."""
    gain = gains(feature_counts(docs, longest, buckets), feature_counts(target, longest, buckets))
    every = stored(scored(docs, gain, longest, seed), "scored")
    able = every.where(f"n_words >= {min_words}")
    r = able.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"),
                 F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                 F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = percent * r["n"] // 100
    if not drawn:
        return every.select(*columns, F.lit(None).cast("long").alias("rank"))
    keys = [_id_key(r["first"], r["last"]), ("cast(doc_id is null as long)", int(r["none"] > 0)),
            (f"({r['high']}L - score)", (r["high"] - r["low"]).bit_length())]
    ranked = radix_ranks(able.select("block", "at", *columns), keys, r["n"], 2 * parallelism(docs.sparkSession))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = every.where(f"n_words < {min_words}").select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).union(rest)


def _id_key(first: int | None, last: int | None) -> tuple[str, int]:
    """Ids from the smallest on; ids that span more than a long's positive range
    keep their bits with the sign turned, which is their unsigned order."""
    if first is None:
        return "0L", 0
    if last - first < 1 << 63:
        low = f"{first}L" if first > -(1 << 63) else "(-9223372036854775807L - 1L)"
        return f"coalesce(doc_id - {low}, 0L)", (last - first).bit_length()
    return "coalesce(doc_id ^ (-9223372036854775807L - 1L), 0L)", 64


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql(percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same for runs of one word: crc32 by its table, made from its polynomial."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
own AS (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents),
own_words AS (SELECT r, unnest(w) AS w FROM own),
target_words AS (SELECT unnest({found}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM own_words UNION SELECT w FROM target_words)),
placed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
                lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % {buckets} AS bucket
  FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS s FROM own_words JOIN placed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN placed USING (w) GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM own_words) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + {buckets}) AS DOUBLE)
         / CAST((coalesce(s, 0) + 1) * (t_all + {buckets}) AS DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket), total),
weighed AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM own_words JOIN placed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
         / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM own LEFT JOIN weighed USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id ASC NULLS LAST) AS k,
         count(*) OVER (PARTITION BY n_features >= {min_words}) AS n
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {min_words} AND k <= {percent} * n // 100 THEN k END AS rank
FROM ranked"""
