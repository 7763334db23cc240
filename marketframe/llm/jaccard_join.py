"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document is its set of distinct five-word shingles (64-bit hashes; fewer
words: the whole sequence as one). Two documents link when
100 * intersection >= 75 * union. Documents with equal sets form one class; a
class takes part once and its key is a 64-bit fold of its set.

Prefix principle: linked sets A and B share at least ceil(0.75 n) elements of
each, so under ANY global order of shingles the first n - ceil(0.75 n) + 1
elements of both share one. It holds for every order at once, so a pair has to
pass all of them before it is verified.

1. Order "rare first", as a filter on single documents. Shingles that only one
   class has come first; a prefix of nothing else cannot share anything. So a
   class survives only if at least ceil(0.75 n) of its shingles are shared.
   Shingles travel as packed, sorted blocks to parts of the hash space; the
   reply is one count per class and part.
2. Over the survivors, exact frequencies among them, then three orders, all
   rarest first, with different ties and different frequency scales, so that
   passages shared by many documents stay out of the prefixes.
3. Hubs: the hub of a bucket of the first order is its document with the most
   common shingles, which is near the centre of a group of edited copies. Every
   document is compared with two hubs: the most central one of its buckets and
   that of its rarest shingle. Links found merge components.
4. Completion: all pairs of a bucket whose components still differ, whose sizes
   and places of the shared shingle allow a link and whose prefixes meet under
   the second and the third order as well, are verified exactly. Pairs inside a component need no test:
   the result is components. Nothing is capped or dropped.

Defined cases: null or empty texts have no shingles and link with nothing; rows
with equal text fall in one class whatever their id; a null doc_id takes part
but never names a component (null if all ids are null); repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import distinct_by_owner, free_names, mix, ngrams, parallelism, stored, table, text_blocks, tidy
from marketframe.llm.components import components

WORDS = 5
PERCENT = 75
# Shingles gathered per task before a set of packed rows leaves it.
FLUSH = 400_000


def need(n, percent: int = PERCENT):
    """Fewest shared elements that a set of size n must have with a linked one."""
    return -(-n * percent // 100)


def class_key(h: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fold, size) of each text's distinct shingles."""
    n = np.bincount(own, minlength=texts).astype(np.int64)
    fold = np.zeros(texts, np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        fold[own[first]] = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), first)
    return mix(fold + n.astype(np.uint64)).view(np.int64), n


def _planes(x: np.ndarray) -> bytes:
    """Differences of sorted uint32 values, byte planes apart (they compress)."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(p).view("<u4").ravel(), dtype=np.uint32)


def _packed(sig, ids, valid, n, rid, h, own, parts: int) -> Iterator[dict]:
    """One row per part of the hash space, from a block of distinct classes and
    all documents. Shingles that several classes of the block have travel once
    (``common``), with a count per class; the others with their class."""
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    high = (h >> np.uint64(32)).astype(np.int64) * parts >> 32  # ascends with h
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    several = np.bincount(run, minlength=1)[run] > 1 if len(h) else new
    cut = np.searchsorted(high, np.arange(parts + 1))
    where = sig.view(np.uint64) % np.uint64(parts)
    for p in range(parts):
        a, b = int(cut[p]), int(cut[p + 1])
        mine = where == p
        if a == b and not mine.any():
            continue
        low, who, twice, lead = h[a:b].astype(np.uint32), own[a:b], several[a:b], new[a:b]
        local = np.bincount(who[twice], minlength=1) if twice.any() else np.zeros(0, np.int64)
        used = np.unique(who)
        single = np.sort(low[~twice])
        yield {"part": p, "docs": sig[used].astype("<i8").tobytes(),
               "local": (np.pad(local, (0, max(0, len(sig) - len(local))))[used]).astype("<u4").tobytes(),
               "single": _planes(single),
               "owner": np.searchsorted(used, who[~twice])[np.argsort(low[~twice], kind="stable")]
               .astype("<u2" if len(used) <= 65536 else "<u4").tobytes(),
               "common": _planes(np.sort(low[twice & lead])),
               "meta": np.stack([ids[mine], valid[mine].astype(np.int64), sig[mine], n[mine], rid[mine]]).astype("<i8").tobytes()}


PACKED = "part int, docs binary, local binary, single binary, owner binary, common binary, meta binary"
_PACKED = pa.schema([("part", pa.int32())] + [(k, pa.binary()) for k in ("docs", "local", "single", "owner", "common", "meta")])


def packed_shingles(docs: DataFrame, parts: int, words: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = count = 0

        def flush():
            sig, ids, valid, n, rid, h = (np.concatenate([x[k] for x in held]) for k in range(6))
            shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            own = np.concatenate([x[6] + s for x, s in zip(held, shift)])
            held.clear()
            _, first = np.unique(sig, return_index=True)  # one document of each class
            leader = np.zeros(len(sig), bool)
            leader[first] = True
            keep = leader[own]
            h, own = h[keep], own[keep]
            rows = list(_packed(sig, ids, valid, n, rid, h, own, parts))
            return pa.RecordBatch.from_pylist(rows, schema=_PACKED)

        for batch in batches:
            ids = batch.column(0)
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rid = batch.column(2).to_numpy(zero_copy_only=False)
            for block in text_blocks(batch.column(1)):
                h, own = distinct_by_owner(*ngrams(block, words)[:2])
                sig, n = class_key(h, own, len(block))
                at = slice(block.first, block.first + len(block))
                if held and (size + len(h) > FLUSH or count + len(block) > 60_000):
                    yield flush()
                    size = count = 0
                held.append((sig, ids[at], valid[at], n, rid[at], h, own))
                size, count = size + len(h), count + len(block)
        if held:
            yield flush()

    return docs.mapInArrow(tidy(pack), PACKED)


FACTS = "kind int, sig long, doc_id long, n long, shared long, text_hash long"
_FACTS = pa.schema([("kind", pa.int32())] + [(k, pa.int64()) for k in ("sig", "doc_id", "n", "shared", "text_hash")])


def _part_facts(group: pa.Table) -> pa.Table:
    """Of one part: its documents (kind 0), and per class how many of its
    shingles of this part some other class has too (kind 1)."""
    h, who, common, names, counts, meta, block = [], [], [], [], [], [], []
    for at, row in enumerate(group.to_pylist()):
        docs = np.frombuffer(row["docs"], "<i8")
        local = np.frombuffer(row["local"], "<u4")
        names.append(docs[local > 0])
        counts.append(local[local > 0].astype(np.int64))
        one = _unplanes(row["single"])
        h.append(one)
        who.append(docs[np.frombuffer(row["owner"], "<u2" if len(docs) <= 65536 else "<u4")])
        block.append(np.full(len(one), at, np.int32))
        common.append(np.unique(_unplanes(row["common"])))
        meta.append(np.frombuffer(row["meta"], "<i8").reshape(5, -1))
    h, who, common, block = np.concatenate(h), np.concatenate(who), np.concatenate(common), np.concatenate(block)
    meta = np.concatenate(meta, axis=1)
    order = np.lexsort((block, who, h))
    h, who, block = h[order], who[order], block[order]
    if len(h):
        # shingles of a class that agree in the bits left are as many as in one block;
        # the same class in another block is the same again
        pair = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
        new = pair.copy()
        new[1:] |= block[1:] != block[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        times = np.maximum.reduceat(size, np.flatnonzero(pair[first]))
        h, who = h[pair], who[pair]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.cumsum(new) - 1
        shared = (np.bincount(run)[run] > 1) | np.isin(h, common)
        name, at = np.unique(who[shared], return_inverse=True)
        names.append(name)
        counts.append(np.bincount(at, weights=times[shared], minlength=len(name)).astype(np.int64))
    names, counts = np.concatenate(names).astype(np.int64), np.concatenate(counts).astype(np.int64)
    k, m = len(names), meta.shape[1]
    nulls = np.ones(k, bool)
    return pa.table([pa.array(np.concatenate([np.zeros(m, np.int32), np.ones(k, np.int32)])),
                     pa.array(np.concatenate([meta[2], names])),
                     pa.array(np.concatenate([meta[0], np.zeros(k, np.int64)]), mask=np.concatenate([meta[1] == 0, nulls])),
                     pa.array(np.concatenate([meta[3], np.zeros(k, np.int64)]), mask=np.concatenate([np.zeros(m, bool), nulls])),
                     pa.array(np.concatenate([np.zeros(m, np.int64), counts])),
                     pa.array(np.concatenate([meta[4], np.zeros(k, np.int64)]))], schema=_FACTS)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(sig, n, tokens) of each document; tokens distinct."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                h, own = distinct_by_owner(*ngrams(block, words)[:2])
                sig, n = class_key(h, own, len(block))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
                    names=["sig", "n", "tokens"])

    return docs.select("text").mapInArrow(tidy(cut), "sig long, n long, tokens array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    return (both.select("a", "b", inter.alias("i"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
            .where(F.expr(f"100 * i >= {percent} * (na + nb - i)")).select("a", "b"))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, text_hash, sig, n; labels: node, comp). Classes without a link
    to another class are not in labels."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = 4 * parallelism(spark)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    facts = stored(packed_shingles(docs, parts, words).groupBy("part").applyInArrow(_part_facts, FACTS), "facts")
    members = facts.where("kind = 0").select("doc_id", "text_hash", "sig", "n")

    # 1. classes with enough shared shingles
    size = members.groupBy("sig").agg(F.max("n").alias("n"))
    shared = facts.where("kind = 1").groupBy("sig").agg(F.sum("shared").alias("shared"))
    alive = stored(shared.join(size, "sig").where(f"n > 0 and 100 * shared >= {percent} * n").select("sig"), "alive")
    leaders = members.join(alive, "sig").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.join(leaders.where("doc_id is not null"), "doc_id", "left_semi").select("text")
    texts = texts.union(docs.where("doc_id is null").select("text"))
    sets = stored(_sets(texts, words).join(alive, "sig", "left_semi").dropDuplicates(["sig"]), "sets")

    # 2. three orders over the survivors
    tokens = sets.select("sig", "n", F.explode("tokens").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    room = F.expr(f"n - cast(ceil(n * {percent} / 100) as long) + 1 - (n - k)")
    listed = (tokens.join(often, "t").groupBy("sig", "n")
              .agg(F.collect_list(F.struct("df", "t")).alias("x"))
              .withColumn("k", F.size("x").cast("long"))
              .withColumn("centre", F.aggregate("x", F.lit(0.0), lambda s, e: s + e["df"]) / F.col("n")).withColumn("room", room.cast("int")).where("room > 0"))

    def order(scale: str, tie: str):
        key = F.transform("x", lambda s: F.struct(_scaled(s["df"], scale).alias("o"),
                                                  (s["t"] if tie == "t" else F.xxhash64(s["t"], F.lit(tie))).alias("h"),
                                                  s["t"].alias("t")))
        return F.transform(F.slice(F.sort_array(key), F.lit(1), F.col("room")), lambda s: s["t"])

    prefixes = stored(listed.select("sig", "n", "k", "centre", order("exact", "t").alias("p1"), order("exact", "second").alias("p2"),
                                    order("log", "third").alias("p3")), "prefixes")
    # tail: elements of the set from this one on; lead: whether it stands in the shorter prefix that is enough
    # for the smaller set of a pair (which shares at least need(2 n) of the two sets' elements together)
    both = 100 + percent
    bucket = (prefixes.select("sig", "n", "k", "centre", F.posexplode("p1").alias("at", "t")).withColumn("tail", F.expr("k - at"))
              .withColumn("lead", F.expr(f"tail >= cast(ceil(n * {2 * percent} / {both}) as long)")).drop("k", "at"))

    # 3. hubs
    hub = (bucket.groupBy("t").agg(F.max(F.struct("centre", "sig")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("t", "hub"))
    pairs = (bucket.join(hub, "t").where("sig != hub.sig").groupBy(F.col("sig").alias("a"))
             .agg(F.max("hub").alias("centre"), F.max(F.struct("tail", "hub")).alias("rarest"))
             .select("a", F.explode(F.array_distinct(F.array("centre.sig", "rarest.hub.sig"))).alias("b")))
    links = stored(_linked(pairs, sets, percent), "links")
    labels = components(links)

    # 4. what is left between components
    entry = stored(bucket.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
                   .withColumn("comp", F.coalesce("comp", "sig")), "entries")
    mixed = entry.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("t")
    entry = entry.join(mixed, "t")
    # the smaller set (ties: the smaller key) meets with its short prefix, the larger one with its whole
    # prefix; what both have from the shared element on must be enough for a link
    bounds = (F.min("n").alias("least"), F.max("n").alias("most"), F.max("tail").alias("tail"))
    small = entry.where("lead").groupBy("t", "comp").agg(*bounds)
    large = entry.groupBy("t", "comp").agg(*bounds)
    facing = (small.alias("x").join(large.alias("y"), F.expr(
        f"x.t = y.t and x.comp != y.comp and x.least <= y.most and 100 * x.most >= {percent} * y.least "
        f"and {both} * least(x.tail, y.tail) >= {percent} * (x.least + greatest(x.least, y.least))"))
        .select("x.t", F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"), F.col("y.least").alias("low"),
                F.col("y.most").alias("high"), F.col("y.tail").alias("far")))
    # rows of the smaller set against the bounds of the other group, then pairs of rows
    first = (facing.join(entry.where("lead").select("t", F.col("comp").alias("ca"), F.col("sig").alias("a"), F.col("n").alias("na"),
                                                    F.col("tail").alias("la")), ["t", "ca"])
             .where(f"na <= high and 100 * na >= {percent} * low and {both} * least(la, far) >= {percent} * (na + greatest(na, low))"))
    pairs = (first.join(entry.select("t", F.col("comp").alias("cb"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tail").alias("lb")),
                        ["t", "cb"])
             .where("na < nb or na = nb and a < b")
             .where(f"100 * na >= {percent} * nb and {both} * least(la, lb) >= {percent} * (na + nb)").select("a", "b").distinct())
    pairs = (pairs.join(prefixes.select(F.col("sig").alias("a"), F.col("p2").alias("a2"), F.col("p3").alias("a3")), "a")
             .join(prefixes.select(F.col("sig").alias("b"), F.col("p2").alias("b2"), F.col("p3").alias("b3")), "b")
             .where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b"))
    rest = _linked(pairs, sets, percent)
    return members, components(links.union(rest))


def _scaled(df, scale: str):
    """Frequency on the scale of an order: itself, or its binary magnitude."""
    return df if scale == "exact" else F.floor(F.log2(df.cast("double")))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, sig, n_shingles, component_id, comp) of every document:
    comp tells components apart whose ids repeat or are null."""
    members, labels = classes(docs, words, percent)
    # one row per class: its component and its smallest id
    named = (members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
             .join(labels.withColumnRenamed("node", "sig"), "sig", "left")
             .withColumn("comp", F.coalesce("comp", "sig")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("sig", "component_id", "comp")
    alone = members.where("n = 0").select("doc_id", "text_hash", "sig", F.col("n").alias("n_shingles"),
                                         F.col("doc_id").alias("component_id"), F.col("sig").alias("comp"))
    return (members.where("n > 0").join(named, "sig")
            .select("doc_id", "text_hash", "sig", F.col("n").alias("n_shingles"), "component_id", "comp").union(alone))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each group of linked ones: the smallest
    doc_id (ids before nulls), then the smallest text hash. Documents without a
    shingle are no group and stay. All columns are kept."""
    rows = jaccard_components(docs, words, percent).where("n_shingles > 0")
    named = stored(rows.groupBy(F.col("comp").alias("group"), "doc_id", "text_hash").agg(F.count("*").alias("rows")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    i, th, stays, mine = free_names(docs, "id", "th", "stays", "own_hash")
    fate = (named.join(named.groupBy("group").agg(first), "group")
            .withColumn("here", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
            .where("not here or rows > 1").select(F.col("doc_id").alias(i), F.col("text_hash").alias(th), F.col("here").alias(stays)))
    fate = stored(fate, "fate")
    keyed = docs.withColumn(mine, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(fate, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(th)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where(F.col(stays).isNull()).select(*names)
    repeated = joined.where(F.col(stays)).dropDuplicates([i, th]).select(*names)
    return once.union(repeated)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
