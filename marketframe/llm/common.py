"""Helpers shared by the training-data operators: table access, the shared
scratch folder, and block-wise word segmentation of Arrow text columns.

Word rules used by all of them: a word is a maximal run of bytes other than
space and 0x09-0x0D (these bytes never occur inside a multi-byte UTF-8
character, so bytes and code points give the same words).
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketframe.session import ensure_checkpoint_dir

# Texts are processed in blocks of about this many bytes (one text at least),
# so that temporary arrays stay small whatever the Arrow batch holds.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Shuffle parallelism of the session (the deployment sizes it with the data)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage
    with a copy that survives lost executors, and keeps Parquet pruning."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_finished(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps that nothing refers to
    any more: it acts when the driver collects garbage, which a loop of small
    plans over large shuffles seldom makes it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a folder URI or plain path."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            return fs.LocalFileSystem(), uri[len("file:"):]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def release() -> None:
    """Give freed memory back to the system: Python workers serve many tasks, and
    what allocators keep of one task's arrays adds up next to the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work: Callable) -> Callable:
    """A function over Arrow batches that releases memory when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


class Texts:
    """A block of consecutive texts: one byte buffer and n + 1 offsets into it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Blocks of the column's texts; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        part = offsets[lo:hi + 1]
        yield Texts(data[part[0]:part[-1]], part - part[0], lo)
        lo = hi


def byte_class(*parts: int | range) -> np.ndarray:
    """Boolean table over byte values: the given ones."""
    table = np.zeros(256, bool)
    for part in parts:
        table[part if isinstance(part, int) else np.array(part)] = True
    return table


_SPACE = byte_class(0x20, range(0x09, 0x0E))
SOLID = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(block: Texts, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every maximal run of bytes of a class."""
    n = len(block.data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = solid[block.data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(block.offsets, start, side="right") - 1
    return start, end, owner


def words(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word of the block."""
    return runs(block, SOLID)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix = _mix
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
LONG_SPAN = 1024  # bytes from which a span is hashed by itself


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one little-endian number
    (a view on a zero-padded copy; loads need not be aligned)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of every span data[start:end] (spans not empty); another one for every salt.

    Eight bytes a step; every step mixes state and bytes through multiplications
    and shifts, so no step is linear and complementary patterns do not cancel.
    Spans of ``LONG_SPAN`` bytes or more take a digest each.
    """
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    at8 = _chunks(data)
    v = at8[start] & _MASKS[np.minimum(size, 8)]
    salt8 = _mix(np.array([salt], np.uint64))  # 0 for salt 0
    h = _mix((v ^ salt8) * _ODD + size.astype(np.uint64) * _KEY)
    todo = np.flatnonzero((size > 8) & (size < LONG_SPAN))
    k = 8
    while len(todo):
        rest = size[todo] - k
        v = at8[start[todo] + k] & _MASKS[np.minimum(rest, 8)]
        h[todo] = _mix(h[todo] + v * _ODD) + _mix(v ^ _KEY)
        todo = todo[rest > 8]
        k += 8
    for i in np.flatnonzero(size >= LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, key=salt.to_bytes(8, "little")).digest(), "little")
    return _mix(h)


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span numbered other[i]."""
    size = end - start
    same = size == size[other]
    at8 = _chunks(data)
    todo, k = np.flatnonzero(same & (other != np.arange(len(size)))), 0
    while len(todo):
        rest = size[todo] - k
        mask = _MASKS[np.minimum(rest, 8)]
        ok = (at8[start[todo] + k] ^ at8[start[other[todo]] + k]) & mask == 0
        same[todo[~ok]] = False
        todo = todo[ok & (rest > 8)]
        k += 8
    return same


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of one span of each distinct content, index of each span's
    content among them). Hashes only find the groups; bytes decide, so two
    contents with one hash stay apart."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~equal_spans(data, start, end, first[inverse]))
    if len(odd):
        more: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            raw = data[start[i]:end[i]].tobytes()
            if raw not in more:
                more[raw] = len(first) + len(extra)
                extra.append(i)
            inverse[i] = more[raw]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, inverse


class Cache:
    """Bounded map of two generations: the older one is dropped when the
    younger is full, so frequent keys stay (they are promoted on a hit)."""

    def __init__(self, limit: int = 100_000):
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def chained(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a run that goes on by one word: run hash, then word hash."""
    return _mix(h * _ODD + w) ^ (h >> np.uint64(7))


def ngrams(block: Texts, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first byte, end byte) of every run of ``n`` words; a
    text with fewer words gives its whole sequence as one, an empty one none.
    ``lower`` folds A-Z only."""
    data = LOWER[block.data] if lower else block.data
    start, end, owner = words(block)
    w = span_hashes(data, start, end)
    m = len(w) - n + 1
    if m > 0:
        full = owner[:m] == owner[n - 1:]
        h = w[:m]
        for k in range(1, n):
            h = chained(h, w[k:k + m])
        h, own, lo, hi = h[full], owner[:m][full], start[:m][full], end[n - 1:][full]
    else:
        h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lo = hi = own
    size = np.bincount(owner, minlength=len(block))
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = []
        for i, f in zip(short.tolist(), first.tolist()):
            k = int(size[i])
            run = np.full(1, k, np.uint64)  # its length first: no run of n words is equal to it
            for j in range(f, f + k):
                run = chained(run, w[j:j + 1])
            extra.append((run[0], i, start[f], end[f + k - 1]))
        h = np.concatenate([h, np.array([e[0] for e in extra], np.uint64)])
        own = np.concatenate([own, np.array([e[1] for e in extra], np.int64)])
        lo = np.concatenate([lo, np.array([e[2] for e in extra], np.int64)])
        hi = np.concatenate([hi, np.array([e[3] for e in extra], np.int64)])
        order = np.argsort(own, kind="stable")
        h, own, lo, hi = h[order], own[order], lo[order], hi[order]
    return h, own, lo, hi


def distinct_by_owner(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner) pairs, by owner, hashes ascending."""
    if not len(h):
        return h, own
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]
