"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of the items are seeds. Documents emit the passages around their
   seed hits: as many words to both sides as the longest item of the hit's
   length class can need (a score of 0.5 leaves room for at most as many gaps as
   the item has words).
2. Passages and items are joined on seeds, rarest first: seeds are ordered by
   the passages that hold them, and each passage and item meet once, at the
   rarest seed that they share.
3. A frequent seed alone says little. An alignment of score ``THRESHOLD`` t matches
   at least t of the item's words (score = 2 * matches - edits of 2 * words), so
   a pair whose passage holds fewer of the item's words, repeats counted, is not
   aligned: the bound is exact and loses nothing. Pairs that meet at a
   seed of at most ``RARE`` passages are aligned at once.
4. Each remaining pair is aligned locally on words (match +2, mismatch -1, gap
   -1). score = best / (2 * words of the item); pairs of a score of
   ``THRESHOLD`` or more are contaminated.

Every n-gram of an item is a seed, since a copy may keep any one of them only;
rarity decides the order and the test, never whether a pair is seen. Tasks test
n-grams against Bloom filters of fixed size, one per length class, before they
emit them; the join decides. The filters are built by a bit-or aggregate: at
most BLOOM_BITS / 64 rows a class reach the driver whatever the benchmark holds.

Defined cases: words fold A-Z; items without words match nothing; items of
fewer than GRAM words match only texts that consist of the same words; null and
empty texts match nothing; rows without doc_id report a null id; repeated
documents or items are reported for each distinct id; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import Cache, LOWER, Texts, free_names, ngrams, stored, table, text_blocks, tidy, words

GRAM = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOOM_BITS = 1 << 23
SECOND = 23  # bits of a hash below the second place
RARE = 20  # passages up to which a seed is rare


def length_class(n):
    """Number of binary digits of an item's words: its reach is below 2 ** class."""
    return F.length(F.bin(n))


def blooms(grams: DataFrame) -> dict[int, np.ndarray]:
    """Bit set of the ``h`` column, two bits each, per length class of the items."""
    both = F.array(*[F.expr(f"shiftrightunsigned(h, {k}) & {BLOOM_BITS - 1}L") for k in (0, SECOND)])
    cells = (grams.select(length_class(F.col("n")).alias("size"), F.explode(both).alias("at"))
             .select("size", F.expr("shiftright(at, 6)").alias("w"), F.expr("cast(at & 63 as int)").alias("b")).groupBy("size", "w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).collect())
    out: dict[int, np.ndarray] = {}
    for c in cells:
        out.setdefault(c["size"], np.zeros(BLOOM_BITS // 64, np.int64))[c["w"]] = c["bits"]
    return out


def _hits(h: np.ndarray, bits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions of possible seeds, the reach that the longest class asks for)."""
    mask = np.uint64(BLOOM_BITS - 1)
    one, two = (h & mask).view(np.int64), (h >> np.uint64(SECOND) & mask).view(np.int64)
    reach = np.zeros(len(h), np.int64)
    for size in sorted(bits):
        maybe = np.flatnonzero((bits[size][one >> 6] >> (one & 63)) & 1)
        at = two[maybe]
        reach[maybe[(bits[size][at >> 6] >> (at & 63)) & 1 != 0]] = 2 * ((1 << size) - 1)
    hits = np.flatnonzero(reach)
    return hits, reach[hits]


def item_grams(items: DataFrame) -> DataFrame:
    """(item, at, h, n): every n-gram of every item, n = the item's words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for block in text_blocks(b.column(1)):
                h, own, _, _ = ngrams(block, GRAM)
                n = np.bincount(words(block)[2], minlength=len(block))
                first = np.searchsorted(own, np.arange(len(block)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own + block.first)), pa.array(np.arange(len(own)) - first[own], pa.int32()),
                     pa.array(h.view(np.int64)), pa.array(n[own], pa.int32())], names=["item", "at", "h", "n"])

    return items.select("item", "text").mapInArrow(tidy(cut), "item long, at int, h long, n int")


def passages(docs: DataFrame, bits: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, text_hash, first, text, seeds): passages of a document around
    possible seed hits; hits of overlapping passages share one. ``first`` is a
    word index, ``text_hash`` that of the whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, out = b.column(0), b.column(2), {"at": [], "first": [], "text": [], "seeds": []}
            for block in text_blocks(b.column(1)):
                h, own, lo, _ = ngrams(block, GRAM)
                start, end, owner = words(block)
                folded = LOWER[block.data].tobytes()
                at, reach = _hits(h, bits)
                word = np.searchsorted(start, lo[at])
                low = np.maximum(word - reach, np.searchsorted(owner, own[at]))
                high = np.minimum(word + GRAM + reach, np.searchsorted(owner, own[at], side="right"))
                k = 0
                while k < len(at):
                    j, top = k + 1, high[k]
                    while j < len(at) and own[at[j]] == own[at[k]] and low[j] <= top:
                        top = max(top, high[j])
                        j += 1
                    out["at"].append(int(own[at[k]]) + block.first)
                    out["first"].append(int(low[k] - np.searchsorted(owner, own[at[k]])))
                    out["text"].append(folded[start[low[k]]:end[top - 1]])
                    out["seeds"].append(np.unique(h[at[k:j]]).view(np.int64).tolist())
                    k = j
            if out["at"]:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out["at"], pa.int64())), hashes.take(pa.array(out["at"], pa.int64())), pa.array(out["first"], pa.int64()),
                     pa.array(out["text"], pa.binary()).cast(pa.string()), pa.array(out["seeds"], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "first", "text", "seeds"])

    return docs.mapInArrow(tidy(cut), "doc_id long, text_hash long, first long, text string, seeds array<long>")


def align(a: list, b: list) -> tuple[int, int, int]:
    """Best local alignment of word lists a (item) and b (passage): score and the
    span of b. Rows over b; a gap run inside a row is a running maximum."""
    code = {w: i for i, w in enumerate(dict.fromkeys(a))}
    y = np.array([code.get(w, -1) for w in b])
    m = len(y)
    if not m or not a:
        return 0, 0, 0
    col = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    origin = col.copy()
    best = (0, 0, 0)
    for w in a:
        diag = row[:-1] + np.where(y == code[w], MATCH, MISMATCH)
        up = row[1:] + GAP
        new = np.zeros(m + 1, np.int64)
        start = col.copy()
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        start[1:] = np.where(new[1:] == 0, col[1:], np.where(diag >= up, origin[:-1], origin[1:]))
        lifted = new - GAP * col  # best over earlier cells of the row, less the gaps between
        lead = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == lead, col, 0))
        new, start = lead + GAP * col, start[source]
        row, origin = new, start
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j)
    return best


def shared_words(a: list, b: list) -> int:
    """Words that a and b have in common, repeats counted: no alignment matches more."""
    left = Counter(a)
    return sum(min(n, left[w]) for w, n in Counter(w for w in b if w in left).items())


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, score, first_word, end_word): the best
    alignment of each document and item that reaches the threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    items = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("text is not null").distinct().withColumn("item", F.xxhash64("text")))
    texts = items.select("item", "text").dropDuplicates(["item"])
    seeds = stored(item_grams(texts).select("item", "h", "n").distinct(), "seeds")
    near = stored(passages(docs, blooms(seeds)), "passages").withColumn("p", F.xxhash64("doc_id", "text_hash", "first"))
    hits = near.select("p", F.explode("seeds").alias("h")).join(seeds.select("h").distinct(), "h", "left_semi")
    often = hits.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    # a passage and an item meet once, at the rarest seed that they share
    pairs = (hits.join(seeds.join(often, "h").select("h", "item", "held"), "h").groupBy("p", "item").agg(F.min("held").alias("held")))
    both = (pairs.join(near.select("p", "doc_id", "text_hash", "first", F.col("text").alias("passage")).dropDuplicates(["p"]), "p")
            .join(texts.withColumnRenamed("text", "item_text"), "item")
            .select("doc_id", "item", "first", "passage", "item_text", "text_hash", "held"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(2_000)

        def split(item: str) -> list:
            got = cache.get(item)
            if got is None:
                got = _words(item)
                cache.put(item, got)
            return got

        for b in batches:
            out = []
            for passage, item, held in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(6).to_pylist()):
                a, w = split(item), _words(passage)
                if held > RARE and shared_words(a, w) < threshold * len(a):
                    out.append((0.0, 0, 0))
                    continue
                best, lo, hi = align(a, w)
                out.append((best / (MATCH * len(a)) if a else 0.0, lo, hi))
            first = b.column(2).to_numpy()
            s, lo, hi = (np.array([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((first + lo).astype(np.int64)),
                 pa.array((first + hi).astype(np.int64)), b.column(5)],
                names=["doc_id", "item", "score", "first_word", "end_word", "text_hash"])

    schema = "doc_id long, item long, score double, first_word long, end_word long, text_hash long"
    hits = both.mapInArrow(tidy(score), schema).where(F.col("score") >= threshold)
    best = hits.groupBy("doc_id", "text_hash", "item").agg(F.max_by(F.struct("score", "first_word", "end_word"),
                                                       F.struct("score", -F.col("first_word"))).alias("b"))
    return best.join(items.select("item", "item_id").distinct(), "item").select("doc_id", "text_hash", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a contaminated pair, all columns kept."""
    [h] = free_names(docs, "hash")
    bad = stored(contaminated(docs, items, threshold).select(F.col("text_hash").alias(h)).distinct(), "contaminated")
    hashed = F.xxhash64(F.col("text").cast("string"))
    return docs.join(bad, hashed == F.col(h), "left_anti")


def _words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    block = Texts(LOWER[raw], np.array([0, len(raw)]), 0)
    start, end, _ = words(block)
    data = block.data.tobytes()
    return [data[s:e] for s, e in zip(start.tolist(), end.tolist())]


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
