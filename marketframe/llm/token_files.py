"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

One file pair per output partition, in ascending doc_id order over the parts:

* ``part-NNNNN-<attempt>.bin``  token ids, little-endian uint16 (uint32 for
  vocabularies over 65,536), nothing between documents;
* ``part-NNNNN-<attempt>.idx``  n + 1 little-endian uint64 token offsets within
  the part, then n int64 doc ids (null ids come first; the manifest counts them);
* ``manifest.json``  per part: name, rows, rows without an id, tokens, and the
  part's base = prefix sum of the token counts of the parts before it.

Readers memory-map the files (local or mounted folders) or read them through
their file system. Tasks write under attempt-unique names and report them, so a
task that is run again never touches a reported file.

Defined cases: null and empty texts hold only the end id; documents with equal
ids are ordered by text hash, then text; null ids come first; an empty table
gives no parts; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from marketframe.llm.common import LOWER, Cache, Texts, distinct_spans, filesystem, parallelism, shared_dir, table, text_blocks, tidy, words

VOCABULARY = "word_bpe_49k.json"
END_ID = 2

_ENCODERS: dict[str, "WordEncoder"] = {}

_LETTER, _DIGIT, _SYMBOL = 1, 2, 3
_KIND = np.zeros(256, np.uint8)  # of printable ASCII bytes
_KIND[0x21:0x7F] = _SYMBOL
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER


def pieces(block: Texts, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the words of a block, cut where the vocabulary
    cuts in any case: behind a letter (a-z, or Latin-1 behind 0xC3), a digit or a
    symbol, before an ASCII byte of another kind or another digit. An ASCII
    character never composes with what stands before it, and no match of the split
    holds two kinds but those that begin with an apostrophe: none is cut behind one."""
    start, end, owner = words(block)
    if not len(start):
        return start, end, owner
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] = _LETTER
    left, right = kind[:-1], kind[1:]
    cut = np.flatnonzero((left > 0) & (right > 0) & ((left != right) | (right == _DIGIT)) & (data[:-1] != 0x27)) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[cut] = edge[start] = True
    first = np.flatnonzero(edge)
    edge[start] = False
    edge[cut] = edge[end] = True
    return first, np.flatnonzero(edge), np.searchsorted(block.offsets, first, side="right") - 1


class WordEncoder:
    """Ids of whole texts from the tokenizers library, piece by piece.

    The vocabulary drops white space, cuts words into pieces and merges inside a
    piece only, so a text's ids are those of its pieces in order. Pieces are
    grouped per block by their bytes; the distinct ones that a bounded cache does not
    have are encoded by the library together. Pieces of small letters that
    no rule of the vocabulary changes or cuts need its model and byte alphabet only.
    Texts holding the start of a special string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.library.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
        self.cache = Cache(200_000)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 65536 else np.dtype("<u4")

    def _library(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids, self.dtype).tobytes()

    def _together(self, some: list[bytes], plain: bool) -> list[bytes]:
        """Ids of each of some pieces."""
        if plain:
            found = self.letters.encode(b" ".join(some).decode("utf-8"), add_special_tokens=False)
        else:
            found = self.library.encode([x.decode("utf-8") for x in some], is_pretokenized=True, add_special_tokens=False)
        raw = np.array(found.ids, self.dtype).tobytes()
        ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))) * self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def coded(self, some: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct pieces."""
        young = self.cache.young.get
        out = [young(x) or self.cache.get(x) for x in some]
        missing = [i for i, x in enumerate(out) if x is None]
        plain = [i for i in missing if self.plain(some[i])]
        held = set(plain)
        for which, rest in ((plain, False), ([i for i in missing if i not in held], True)):
            if not which:
                continue
            for i, ids in zip(which, self._together([some[i] for i in which], not rest)):
                out[i] = ids
                if len(some[i]) <= 64:
                    self.cache.put(some[i], ids)
        return out

    def block(self, block: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        data = LOWER[block.data]  # merges pieces: the vocabulary lower-cases
        start, end, owner = pieces(block, data)
        marks = np.flatnonzero(data[:-1] == 0x3C) if len(data) > 1 else np.zeros(0, np.int64)
        odd = marks[data[marks + 1] == 0x7C] if len(marks) else marks
        whole = set((np.searchsorted(block.offsets, odd, side="right") - 1).tolist())
        first, inverse = distinct_spans(data, start, end)
        view = data.tobytes()
        coded = self.coded([view[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())])
        flat = np.frombuffer(b"".join(coded), self.dtype)
        size = np.array([len(c) // self.dtype.itemsize for c in coded], np.int64)
        base = np.cumsum(size) - size
        n = size[inverse] if len(inverse) else np.zeros(0, np.int64)
        out = np.cumsum(n) - n
        ids = flat[np.arange(int(n.sum())) - np.repeat(out - base[inverse], n)] if len(n) else flat
        counts = np.bincount(owner, weights=n, minlength=len(block)).astype(np.int64)
        if whole:
            texts, at = [], np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(block)):
                if i in whole:
                    piece = np.frombuffer(self._library(block.raw(i)), self.dtype)
                    counts[i] = len(piece)
                else:
                    piece = ids[at[i]:at[i + 1]]
                texts.append(piece)
            ids = np.concatenate(texts) if texts else ids
        return ids, counts


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


PART = StructType([StructField("part", IntegerType()), StructField("name", StringType()),
                   StructField("docs", LongType()), StructField("null_ids", LongType()),
                   StructField("tokens", LongType())])


def write(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int = END_ID,
          partitions: int | None = None) -> dict:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the manifest.

    Documents are range-partitioned by (doc_id, text hash), so that repeated
    ids spread as far as their texts differ. Only one row per part reaches the
    driver; the prefix sum runs over those rows.
    """
    spark = docs.sparkSession
    partitions = partitions or parallelism(spark)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("h", F.xxhash64("text"))
            .repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "h")
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", F.col("text").asc_nulls_first())
            .withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary_path)
        fs, root = filesystem(folder)
        name, sink = None, None
        ends: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        nulls = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                part = batch.column(0)[0].as_py()
                name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}"
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}.bin")
            nulls += batch.column(1).null_count
            doc_ids.append(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for block in text_blocks(batch.column(2)):
                ids, counts = _with_end(*coder.block(block), end_id)
                sink.write(ids.astype(coder.dtype, copy=False).tobytes())
                ends.append(tokens + np.cumsum(counts))
                tokens += len(ids)
        if sink is not None:
            sink.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(np.concatenate([[0], *ends]).astype("<u8").tobytes())
                out.write(np.concatenate(doc_ids).tobytes())
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": name, "docs": sum(map(len, doc_ids)), "null_ids": nulls, "tokens": tokens}],
                schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()),
                                  ("null_ids", pa.int64()), ("tokens", pa.int64())]))

    parts = sorted((r.asDict() for r in rows.mapInArrow(tidy(save), PART).collect()), key=lambda r: r["part"])
    base = 0
    for p in parts:
        p["base"] = base
        base += p["tokens"]
    manifest = {"folder": folder, "dtype": encoder(vocabulary_path).dtype.str, "end_id": end_id,
                "tokens": base, "parts": parts}
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def open_part(folder: str, part: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, offsets, doc ids) of a part: memory-mapped where the folder
    is local or mounted, read through its file system elsewhere."""
    from pyarrow import fs as pafs
    fs, root = filesystem(folder)
    path = f"{root}/{part['name']}"
    n = part["docs"]
    if isinstance(fs, pafs.LocalFileSystem):
        ids = np.memmap(f"{path}.bin", dtype, "r") if part["tokens"] else np.zeros(0, dtype)
        offsets = np.memmap(f"{path}.idx", "<u8", "r", shape=(n + 1,))
        doc_ids = np.memmap(f"{path}.idx", "<i8", "r", offset=8 * (n + 1), shape=(n,))
        return ids, offsets, doc_ids
    with fs.open_input_file(f"{path}.bin") as f:
        ids = np.frombuffer(f.read(), dtype)
    with fs.open_input_file(f"{path}.idx") as f:
        raw = f.read()
    return ids, np.frombuffer(raw, "<u8", n + 1), np.frombuffer(raw, "<i8", n, 8 * (n + 1))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest(spark: SparkSession, manifest: dict) -> DataFrame:
    """Per document, read back from the files: first token position over all
    parts, number of ids and the crc32 of the ids as 32-bit integers."""
    parts, folder, dtype = manifest["parts"], manifest["folder"], manifest["dtype"]
    if not parts:
        return spark.createDataFrame([], DIGEST)
    listed = spark.createDataFrame([(json.dumps(p),) for p in parts], "part string").repartition(len(parts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                part = json.loads(text)
                ids, offsets, doc_ids = open_part(folder, part, dtype)
                for lo in range(0, part["docs"], 20_000):
                    hi = min(lo + 20_000, part["docs"])
                    at = offsets[lo:hi + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:hi], pa.int64(), mask=np.arange(lo, hi) < part["null_ids"]),
                         pa.array(at[:-1] + part["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(tidy(read), DIGEST)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    manifest = write(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"),
                     public_tokenizers.path(VOCABULARY))
    return digest(spark, manifest)
