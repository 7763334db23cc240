"""Quality rules: counts per document, and repetition by a suffix array over words.

All texts of a block are sorted together: the ranks of their suffixes (by word,
and by text first, so that no suffix meets one of another text) come from prefix
doubling, in which only suffixes that are still tied are sorted again. The ranks
of every doubling are kept: two suffixes have equal ranks of the doubling k exactly
if their first 2 ** k words are the same words. From them follow the longest
common prefixes of neighbours in the suffix array. The intervals of common
prefixes of ``MIN_REPEAT`` words or more whose occurrences do not all follow
the same word are the maximal repeated substrings. A suffix's longest repeat is
the larger of its two common prefixes, and the union of those spans is the union
of all occurrences of the maximal repeats (a repeat that is not maximal to the
left lies in one that is).

A document fails the method if its longest repeat exceeds ``LONGEST`` words or if
repeats cover more than ``COVERED`` percent of its words. One scan, no shuffle; a
text needs about 100 bytes of memory a word.

Defined cases: a null text has no word; texts of fewer than ``MIN_WORDS`` words
fail the base rule; overlapping occurrences count (a word many times in a row
repeats); a null doc_id stays null; equal rows give equal rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import SOLID, Texts, byte_class, distinct_spans, table, text_blocks, tidy, words

MIN_WORDS = 20
WINDOW = 8  # words of the base rule's windows
REPEATED = 30  # percent of words in repeated windows that the base rule allows
MIN_REPEAT = 6  # words from which a repeat counts for the method
COVERED = 30  # percent of words in repeats that the method allows
LONGEST = 40  # words of the longest repeat that the method allows
SYMBOLS = "#*$%&|<>"

_SYMBOL = byte_class(*SYMBOLS.encode())
_BLANK = b" \t\n\v\f\r"


class SuffixArray:
    """Suffix ranks of word sequences, one per text; ``word`` numbers the words
    so that equal numbers are equal words, ``owner`` ascends."""

    def __init__(self, word: np.ndarray, owner: np.ndarray):
        n = len(word)
        self.word, self.owner = word, owner
        key = owner * (int(word.max()) + 1 if n else 1) + word
        order = np.argsort(key, kind="stable")
        tied = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.searchsorted(tied, tied)  # how many suffixes are smaller
        self.levels = [self._kept(rank)]
        k = 1
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        while len(live):
            nxt = live + k
            inside = nxt < n
            inside[inside] = owner[nxt[inside]] == owner[live[inside]]
            follow = np.where(inside, rank[np.minimum(nxt, n - 1)], -1)
            order = np.lexsort((follow, rank[live]))
            live, follow = live[order], follow[order]
            old = rank[live]
            place = np.arange(len(live))
            head = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
            new = np.concatenate([[True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])])
            start = np.maximum.accumulate(np.where(new, place, 0))
            rank[live] = old + start - head
            self.levels.append(self._kept(rank))
            group = np.cumsum(new) - 1
            live = np.sort(live[np.bincount(group)[group] > 1])
            k *= 2
        self.rank = rank

    @staticmethod
    def _kept(rank: np.ndarray) -> np.ndarray:
        """Copy with a place behind the last suffix that equals no rank."""
        return np.append(rank, -1).astype(np.int32 if len(rank) < 2**31 else np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes a[i] and b[i] (a != b)."""
        a, b = a.copy(), b.copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[k][a] == self.levels[k][b], 1 << k, 0)
            length += step
            a += step
            b += step
        return length

    def windows(self, size: int) -> np.ndarray:
        """Number per suffix: equal for suffixes that start with the same
        ``size`` words; -1 where fewer words are left or nothing is equal."""
        n = len(self.word)
        k = min(size.bit_length() - 1, len(self.levels) - 1)
        out = np.full(n, -1, np.int64)
        if not n or 1 << size.bit_length() - 1 != 1 << k:
            return out  # sorted before this length: every longer window is unique
        at = np.arange(n)
        last = at + size - 1
        full = last < n
        full[full] = self.owner[last[full]] == self.owner[at[full]]
        at = at[full]
        pair = self.levels[k][at].astype(np.int64) * (n + 1) + self.levels[k][at + size - (1 << k)]
        out[at] = np.unique(pair, return_inverse=True)[1]
        return out

    def neighbours(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in sorted order, common prefix of each with the one before
        it; 0 where it is shorter than ``least``)."""
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(self.rank))
        lcp = np.zeros(len(order), np.int64)
        k = min(least.bit_length() - 1, len(self.levels) - 1)
        level = self.levels[k]
        near = np.flatnonzero(level[order[1:]] == level[order[:-1]]) + 1
        lcp[near] = self.common(order[near - 1], order[near])
        lcp[lcp < least] = 0
        return order, lcp

    def maximal_repeats(self, order: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
        """(length, from, to) of every maximal repeat: its occurrences are the
        suffixes order[from:to]. Intervals of the common prefixes, kept if their
        occurrences do not all follow one word."""
        n = len(order)
        before = np.where(order > 0, self.word[order - 1], -1) if n else order
        if n:
            first = (order == 0) | (self.owner[order] != self.owner[np.maximum(order - 1, 0)])
            before[first] = -1 - order[first]  # the start of a text follows nothing
        out = []
        for lo in np.flatnonzero((lcp > 0) & (np.concatenate([[0], lcp[:-1]]) == 0)).tolist():
            stack = []  # [length, from, smallest and largest word before]
            at = lo
            low = high = int(before[lo - 1])
            while True:
                h = int(lcp[at]) if at < n else 0
                start = at - 1
                while stack and stack[-1][0] > h:
                    length, start, a, b = stack.pop()
                    low, high = min(low, a), max(high, b)
                    if low != high:
                        out.append((length, start, at))
                if h == 0:
                    break
                if stack and stack[-1][0] == h:
                    stack[-1][2], stack[-1][3] = min(low, stack[-1][2]), max(high, stack[-1][3])
                else:
                    stack.append([h, start, low, high])
                low = high = int(before[at])
                at += 1
        return out


def union_of(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, start, start + length)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a flag over the stretch of each text."""
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measures(block: Texts, window: int = WINDOW, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All measures of the texts of a block."""
    start, end, owner = words(block)
    texts, n = len(block), len(start)
    cut = np.searchsorted(owner, np.arange(texts + 1))
    first, word = distinct_spans(block.data, start, end)
    sa = SuffixArray(word.astype(np.int64), owner)

    group = sa.windows(window)
    at = np.flatnonzero(group >= 0)
    twice = at[np.bincount(group[at])[group[at]] > 1] if len(at) else at
    repeated = union_of(twice, np.full(len(twice), window), n)

    order, lcp = sa.neighbours(least)
    match = np.zeros(n, np.int64)
    match[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp
    some = np.flatnonzero(match)
    covered = union_of(some, match[some], n)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner[some], match[some])
    found = np.zeros(texts, np.int64)
    for length, lo, _ in sa.maximal_repeats(order, lcp):
        found[owner[order[lo]]] += 1
    lead = (block.data & 0xC0 != 0x80) & SOLID[block.data]
    return {"n_words": np.diff(cut), "word_chars": per_text(lead, block.offsets),
            "n_symbols": per_text(_SYMBOL[block.data], block.offsets),
            "n_dup_lines": np.array([duplicate_lines(block.raw(i)) for i in range(texts)], np.int64),
            "n_repeat_words": per_text(repeated, cut), "n_repeats": found,
            "covered_words": per_text(covered, cut), "longest_repeat": longest}


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_repeats long, covered_words long, longest_repeat long")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "covered_words", "longest_repeat")


def quality(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, repeated: int = REPEATED,
            least: int = MIN_REPEAT, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """Measures and verdicts of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(block, window, least) for block in text_blocks(batch.column(1))]
            m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in _MEASURES}
            failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeated * m["n_words"])
            kept = ~failed & (100 * m["covered_words"] <= covered * m["n_words"]) & (m["longest_repeat"] <= longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(m[k]) for k in _MEASURES[:5]), pa.array(failed), pa.array(kept),
                 *(pa.array(m[k]) for k in _MEASURES[5:])],
                names=["doc_id", *_MEASURES[:5], "base_failed", "kept", *_MEASURES[5:]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(tidy(judge), SCHEMA)


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
