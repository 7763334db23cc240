"""Mixing sources to target weights by subset-sum budget fitting.

Targets. Sources in code point order (null last) have the weights of a cycle;
all sizes together are shared out by weight, a source's target stops at
``most`` times its size and the excess goes to the others by weight. That is a
water level: target = min(cap, level * weight), found from the sources sorted
by cap / weight.

Fitting. A source is taken floor(target / size) times whole. The rest of its
budget is fitted on the number of documents of each exact length: every length
gives its proportional share, rounded down; a greedy pass from the longest
length fills up to a bounded rest; a bounded-knapsack dynamic programme over
reachable sums (one bit per word, ``DP_WORDS`` at most) finds the sum closest
to it. Documents of a length are then selected in the order of a seeded hash.
Only the hash bucket on the edge of a selection is ranked, so no group of
equal lengths meets in one task.

Defined cases: null and empty texts have size 0 and are never taken; a null
source is a source of its own; equal hashes are ordered by doc_id, nulls first;
rows that repeat entirely are interchangeable; an empty table gives no rows;
other columns pass ``select_rows`` unchanged and are ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import free_names, stored, table, text_blocks, tidy, words

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240229
DP_WORDS = 1 << 15
EDGE_ROWS = 1_000  # documents of one length and source per hash bucket, about


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, hash): ``src`` is a non-null key that sorts as the sources do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.zeros(0, np.int64)]
            for block in text_blocks(b.column(2)):
                n.append(np.bincount(words(block)[2], minlength=len(block)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n), pa.int64()), b.column(3)],
                                             names=["doc_id", "src", "size", "hash"])

    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(SEED)))
    return rows.mapInArrow(tidy(count), "doc_id long, src string, size long, hash long")


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, target) from (src, source_size); one row per source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy("src")
    w = by_source.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    asc = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    w = w.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    # the level is that of the first source which stays under its cap
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("capped"), F.col("level"))))
                     .over(everything)["level"])
    return w.select("src", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def fit_rest(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each length to take for a sum as close to ``rest``
    as found (never above what ``counts`` allows)."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if rest <= 0 or total == 0:
        return take
    if rest >= total:
        return counts.astype(np.int64)
    take = (counts.astype(object) * rest // total).astype(np.int64)
    left = rest - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # longest first, down to the rest that the programme fits
        room = left - DP_WORDS // 2
        if room <= 0:
            break
        more = min(int(counts[i] - take[i]), room // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    if left > DP_WORDS:  # lengths above the rest only: the shortest that is left comes nearest
        spare = [i for i in order[::-1] if counts[i] > take[i]]
        if spare and lengths[spare[0]] < 2 * left:
            take[spare[0]] += 1
        return take
    # bounded knapsack over reachable sums; one bitset after each bundle of equal lengths
    bundles, reach = [], [1]
    mask = (1 << (left + DP_WORDS // 8 + 1)) - 1
    for i in order[::-1]:
        spare, size = int(counts[i] - take[i]), int(lengths[i])
        spare = min(spare, (left + DP_WORDS // 8) // size)
        bundle = 1
        while spare > 0 and not reach[-1] >> left & 1:
            n = min(bundle, spare)
            bundles.append((i, n, n * size))
            reach.append((reach[-1] | reach[-1] << (n * size)) & mask)
            spare -= n
            bundle *= 2
        if reach[-1] >> left & 1:
            break
    sums = reach[-1]
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> (left + 1)
    at = below
    if above:
        up = left + (above & -above).bit_length()
        if up - left < left - below:
            at = up
    for (i, n, weight), had in zip(reversed(bundles), reversed(reach[:-1])):
        if not had >> at & 1:
            take[i] += n
            at -= weight
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per length of one source: whole passes and documents of one more."""
    size, target = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
    passes = min(target // size, MOST) if size else 0
    pdf = pdf.sort_values("size")
    more = fit_rest(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), target - passes * size if size else 0)
    return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "n": pdf["n"], "passes": passes, "more": more,
                         "source_size": size, "target": pdf["target"]})


PLAN = "src string, size long, n long, passes long, more long, source_size long, target double"


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, size, source_size, target, taken) of every document."""
    rows = stored(sizes(docs), "sizes")
    lengths = rows.groupBy("src", "size").agg(F.count("*").alias("n"))
    by_source = lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one row per source and length: bounded by the longest text, not by the documents
    goal = targets(by_source)
    fitted = lengths.where("size > 0").join(goal, "src").groupBy("src").applyInPandas(_plan, PLAN)
    plan = stored(goal.join(lengths, "src").join(fitted.select("src", "size", "passes", "more"), ["src", "size"], "left")
                  .select("src", "size", "n", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("more", F.lit(0)).alias("more"),
                          "source_size", "target")
                  .withColumn("buckets", F.ceil(F.col("n") / EDGE_ROWS).cast("long")), "plan")
    dealt = rows.join(plan, ["src", "size"]).withColumn("bucket", F.pmod("hash", F.col("buckets")))
    partly = "more > 0 and more < n"
    # per length: the bucket in which the selection ends, from bucket counts
    counts = dealt.where(partly).groupBy("src", "size", "bucket", "more").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("src", "size").orderBy("bucket")
    edge = (counts.withColumn("end", F.sum("c").over(upto)).withColumn("begin", F.col("end") - F.col("c"))
            .where("begin < more and end >= more")
            .select("src", "size", F.col("bucket").alias("edge"), (F.col("more") - F.col("begin")).alias("in_edge")))
    dealt = dealt.join(edge, ["src", "size"], "left")
    inside = Window.partitionBy("src", "size", "bucket").orderBy("hash", F.col("doc_id").asc_nulls_first())
    at_edge = (dealt.where("bucket = edge").withColumn("rank", F.row_number().over(inside))
               .withColumn("once", (F.col("rank") <= F.col("in_edge")).cast("long")).drop("rank"))
    rest = dealt.where("edge is null or bucket != edge").withColumn(
        "once", F.expr("case when more >= n and more > 0 then 1 when edge is not null and bucket < edge then 1 else 0 end").cast("long"))
    return (rest.unionByName(at_edge)
            .select("doc_id", "hash", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("once"))).alias("taken")))


def select_rows(docs: DataFrame) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, all columns kept."""
    i, h, t, r, nth, n, copy = free_names(docs, "id", "hash", "times", "rows", "nth", "n", "copy")
    mine = free_names(docs, "own_hash")[0]
    plan = (mix(docs).where("size > 0").select(F.col("doc_id").alias(i), F.col("hash").alias(h),
                                                (F.col("taken") / F.col("size")).cast("int").alias(t))
            .groupBy(i, h).agg(F.sum(t).alias(t), F.count("*").alias(r)).where(F.col(t) > 0))
    keyed = docs.withColumn(mine, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(SEED)))
    plan = stored(plan, "mix")
    joined = keyed.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(h)))
    # rows that repeat entirely share their times; the first ones take one more
    same = Window.partitionBy(i, h).orderBy(F.lit(0))
    repeated = joined.where(F.col(r) > 1).withColumn(nth, F.row_number().over(same))
    once = joined.where(F.col(r) == 1).withColumn(nth, F.lit(1))
    times = F.floor(F.col(t) / F.col(r)) + (F.col(nth) <= F.col(t) % F.col(r)).cast("long")
    return (once.union(repeated).withColumn(n, times.cast("int")).where(F.col(n) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
