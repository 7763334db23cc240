"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as a linked list of its bytes; a heap holds the ranks of its
adjacent pairs. The lowest-ranked pair (leftmost on ties) is popped and merged,
its two new neighbours are pushed, until no known pair is left. The number of
tokens is the number of bytes minus the number of merges; no ids are emitted.

Texts are cut into chunks of white space and the word after it: no piece of the
vocabulary's pre-tokenisation spans a word's end, so the count of a text is the
sum over its chunks. Distinct chunks are counted once per block and kept in a
bounded cache. Texts with white space other than ASCII's, or with a special
string, are pre-tokenised whole.

Defined cases: null counts as the empty text (0 bytes, 0 tokens); a special
string inside a text is one token; other columns are ignored; repeated rows
give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketframe.llm.common import Cache, Texts, distinct_spans, table, text_blocks, tidy, words

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
# Fixed value: the byte-level pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_COUNTERS: dict[str, "MergeCounter"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    visible Latin-1 characters stand for themselves, the rest follow from 256."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeCounter:
    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pieces = regex.compile(PATTERN).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)).split if self.special else lambda t: [t]
        self.odd_space = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.cache = Cache()

    def merge_count(self, piece: bytes) -> int:
        """Number of tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        rank = self.rank
        symbol = [self.first[b] for b in piece]
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = merged, -1
            k = after[j]
            after[i] = k
            merges += 1
            if k >= 0:
                before[k] = i
                found = rank.get((merged, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, merged, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get((symbol[h], merged))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], merged, found[1]))
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(self.merge_count(p.encode("utf-8")) for p in self.pieces(text))

    def text(self, text: str) -> int:
        """Tokens of a whole text; each special string counts one."""
        parts = self.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts)

    def chunk(self, raw: bytes) -> int:
        got = self.cache.get(raw)
        if got is None:
            got = self.plain(raw.decode("utf-8"))
            if len(raw) <= 64:
                self.cache.put(raw, got)
        return got

    def block(self, block: Texts) -> np.ndarray:
        """Tokens of each text of the block."""
        start, end, owner = words(block)
        low = block.offsets[owner]
        if len(start):
            same = np.concatenate([[False], owner[1:] == owner[:-1]])
            low = np.where(same, np.concatenate([[0], end[:-1]]), low)
        first, inverse = distinct_spans(block.data, low, end)
        view = block.data.tobytes()
        count = np.array([self.chunk(view[s:e]) for s, e in zip(low[first].tolist(), end[first].tolist())], np.int64)
        per = np.bincount(owner, weights=count[inverse] if len(start) else None, minlength=len(block)).astype(np.int64)
        tail = block.offsets[:-1].copy()  # white space after the last word
        tail[owner] = end
        for i in np.flatnonzero(tail < block.offsets[1:]).tolist():
            per[i] += self.chunk(view[tail[i]:block.offsets[i + 1]])
        text = view.decode("utf-8")
        if self.odd_space(text) or any(s in text for s in self.special):
            for i in range(len(block)):
                one = block.raw(i).decode("utf-8")
                if self.odd_space(one) or any(s in one for s in self.special):
                    per[i] = self.text(one)
        return per


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = counter(vocabulary_path)
        for batch in batches:
            column = batch.column(1)
            tokens, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in text_blocks(column):
                tokens.append(merges.block(block))
                size.append(np.diff(block.offsets))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(size)), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(count), SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
