"""Phrase collocation mining by sampling and one exact pass (Toivonen's scheme).

Phrases are runs of up to ``longest`` words inside a piece of text, per language.
A run can only be frequent if the runs without its last and without its first
word are frequent.

1. Sample. One document in ``SAMPLE`` proposes the phrases that reach a lowered
   threshold there, level by level.
2. Border and exact counts. One pass over all texts counts every proposed phrase
   and its negative border: the runs that are not proposed while both runs one
   word shorter are. Words are all in one or the other.
3. Expansion. Border phrases that turn out frequent are failures of the sample. A
   further pass then counts the runs that pass 2 left out and whose shorter runs
   are each frequent or were not counted either. A frequent run has only
   frequent shorter runs, so each of them passes this test and the run itself is
   counted: the set is closed after this pass.
4. Texts. Phrases are counted and scored as the 64-bit hashes of their words;
one more pass looks up the texts of the words in the best phrases. Words
carry a second hash where single words are counted: if two words share the
first one, the whole is done again with another salt.

Tasks know the phrases of a set through a filter of 2 ** FILTER_BITS bits, whatever
the size of the set: what it lets through by chance is counted in vain, no
more. Counts are summed per task before the shuffle, which is dealt by phrase,
so that neither a frequent phrase nor a large language fills one task.

Defined cases: null texts have no word, a null lang is ``und``; empty pieces and
runs of white space are nothing; equal rows all count; phrases of equal score and
count are in the order of their UTF-8 bytes; an empty table gives no rows; other
columns are ignored, also such with names that are used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import LOWER, Texts, byte_class, chained, mix, runs, span_hashes, stored, table, text_blocks, tidy

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SAMPLE = 8  # one document in so many proposes phrases
SLACK = 0.5  # share of the threshold's expected count that the sample asks for
FILTER_BITS = 26
HELD = 3 << 17  # phrases that a task holds before it merges or emits them
BLOCK = 1 << 18  # bytes of text whose words a task lays out at a time
EMITTED = 1 << 15  # phrases of a batch that a task emits: the JVM holds batches outside its heap
UNKNOWN = "und"

_SEPARATOR = byte_class(*b".,;:!?", range(0x0A, 0x0E))
_WORD = ~(_SEPARATOR | byte_class(0x20, 0x09))


class PhraseFilter:
    """Set of hashes in a fixed number of bits: never misses a member."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64((1 << bits) - 1)

    @classmethod
    def of(cls, phrases: DataFrame, bits: int = FILTER_BITS) -> "PhraseFilter":
        """From rows (k, w1, ..., w5); the driver gets at most 2 ** (bits - 6) numbers."""
        mask = np.uint64((1 << bits) - 1)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.column(0).to_numpy()
                w = [b.column(1 + j).to_numpy().view(np.uint64) for j in range(WIDTH)]
                h = w[0].copy()
                for j in range(1, WIDTH):
                    at = np.flatnonzero(k > j)
                    h[at] = chained(h[at], w[j][at])
                p = np.concatenate([h & mask, h >> np.uint64(32) & mask]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p)], names=["p"])

        rows = (phrases.select("k", *WORDS).mapInArrow(tidy(places), "p long")
                .groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow())
        words = np.zeros(1 << bits - 6, np.uint64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        return cls(words, bits)

    def _probe(self, p: np.ndarray) -> np.ndarray:
        p = p & self.mask
        return (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0

    def __contains__(self, h):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self._probe(h)
        at = np.flatnonzero(out)
        out[at] = self._probe(h[at] >> np.uint64(32))
        return out


class Segments:
    """Words of a block, their hashes by language, and which runs stay in a piece."""

    def __init__(self, block: Texts, seeds: np.ndarray, salt: int = 0):
        self.data = LOWER[block.data]
        self.start, self.end, self.owner = runs(block, _WORD)
        n = len(self.start)
        piece = np.cumsum(_SEPARATOR[block.data])[self.start] if n else self.start
        self.joined = np.zeros(n, bool)  # with the next word
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.owner[1:] == self.owner[:-1])
        self.h1 = self.hashes(seeds, salt)

    def hashes(self, seeds: np.ndarray, salt: int) -> np.ndarray:
        return mix(span_hashes(self.data, self.start, self.end, salt) ^ seeds[self.owner])

    def walk(self, longest: int):
        """Grow runs a word at a time: yields (length, positions, hashes) of the
        runs whose two parts were let go on, and takes back which of them go on."""
        n = len(self.start)
        go_on, whole = np.ones(n, bool), np.ones(n, bool)
        h = self.h1.copy()
        at = np.arange(n)
        for k in range(1, longest + 1):
            if k > 1:
                whole = whole[:-1] & self.joined[k - 2:][:len(whole) - 1] if len(whole) else whole
                go_on = go_on[:len(whole) + 1]
                at = np.flatnonzero(whole & go_on[:-1] & go_on[1:]) if len(whole) else np.zeros(0, np.int64)
                h[at] = chained(h[at], self.h1[at + k - 1])
            kept = yield k, at, h[at]
            go_on = np.zeros(len(whole), bool)
            go_on[at[kept]] = True


class Tally:
    """Sums of counts by run in bounded memory: per length, rows (hash of the
    run, words, count). The hash only brings equal runs together; words decide."""

    def __init__(self, limit: int = HELD):
        self.parts: dict[int, list] = {}
        self.size, self.limit = 0, limit

    def add(self, k: int, h: np.ndarray, words: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        if not len(h):
            return
        self.parts.setdefault(k, []).append(self._summed(h, words, None))
        self.size += len(self.parts[k][-1][0])
        if self.size > self.limit:
            self.size = 0
            for k in list(self.parts):
                self.parts[k] = [self._merged(k)]
                self.size += len(self.parts[k][0][0])
            if 2 * self.size > self.limit:
                yield from self.rest()

    @staticmethod
    def _summed(h: np.ndarray, words: list[np.ndarray], n: np.ndarray | None) -> tuple:
        order = np.argsort(h, kind="stable")
        new = np.zeros(len(h), bool)
        new[0] = True
        for x in (h, *words):  # one hash, other words: a row of its own
            x = x[order]  # one column at a time, to hold little
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        total = np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n[order], first)
        at = order[first]
        return h[at], [w[at] for w in words], total

    def _merged(self, k: int) -> tuple:
        """The sums of a length, which is taken out."""
        parts = self.parts.pop(k)
        if len(parts) == 1:
            return parts[0]
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        words = [np.concatenate(w) for w in zip(*(p[1] for p in parts))]
        del parts
        return self._summed(h, words, n)

    def rest(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        for k in list(self.parts):
            _, words, n = self._merged(k)
            for lo in range(0, len(n), EMITTED):
                yield k, [w[lo:lo + EMITTED] for w in words], n[lo:lo + EMITTED]
        self.size = 0


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, code of each text, seed of each text's hashes)."""
    coded = column.fill_null(UNKNOWN).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    return names, codes, _seeds(names)[codes]


WIDTH = 5  # words of a phrase at most
WORDS = [f"w{j + 1}" for j in range(WIDTH)]
COUNTS = "lang string, k int, " + ", ".join(f"{w} long" for w in WORDS) + ", n long"


def _rows(lang: list | None, k: int, words: list[np.ndarray], n) -> pa.RecordBatch:
    """Rows of one length; what a phrase has no word for is 0."""
    size = len(n)
    words = [np.asarray(w, np.uint64).view(np.int64) for w in words] + [np.zeros(size, np.int64)] * (WIDTH - len(words))
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()) if lang else pa.nulls(size, pa.string()), pa.array(np.full(size, k, np.int32)),
         *(pa.array(w) for w in words), pa.array(np.asarray(n, np.int64))], names=["lang", "k", *WORDS, "n"])


def run_counts(docs: DataFrame, shortest: int, longest: int, known: list[PhraseFilter], depth: int,
               expand: bool = False, salt: int = 0) -> DataFrame:
    """Counts (k, w1, ..., n) of runs of ``shortest`` to ``longest`` words whose
    two parts are in the last filter of ``known``; parts of more than ``depth``
    words are in it. With ``expand``, only runs that no earlier filter of
    ``known`` let be counted; such runs count as known themselves. Single words
    carry their second hash as w2 and the seed of their language as w3. Rows with
    k = 0 give the number of words per language and its seed as w1 (from passes
    over single words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, total = Tally(), {}
        for batch in batches:
            names, codes, seeds = _languages(batch.column(1))
            for block in text_blocks(batch.column(0), BLOCK):
                own = seeds[block.first:block.first + len(block)]
                s = Segments(block, own, salt)
                if shortest == 1 and not expand:
                    per = np.bincount(codes[block.first + s.owner], minlength=len(names))
                    for name, c in zip(names, per.tolist()):
                        if c:
                            total[name] = total.get(name, 0) + c
                walk = s.walk(longest)
                earlier = s.walk(longest) if expand else None  # what the first pass counted
                before = next(earlier) if expand else None
                k, at, h = next(walk)
                while True:
                    known_run = known[-1].has(h) if k <= depth else np.ones(len(h), bool)
                    fresh = slice(None)
                    if expand:
                        fresh = ~np.isin(at, before[1], assume_unique=True)
                        known_run |= fresh
                    if k >= shortest:
                        new = at[fresh]
                        words = ([s.h1, s.hashes(own, salt + SECOND), own[s.owner]] if k == 1
                                 else [s.h1[new + j] for j in range(k)])
                        for done in tally.add(k, h[fresh], words):
                            yield _rows(None, *done)
                    if k == longest:
                        break
                    if expand:
                        before = earlier.send(known[0].has(before[2]))
                    k, at, h = walk.send(known_run)
        for done in tally.rest():
            yield _rows(None, *done)
        if total:
            yield _rows(list(total), 0, [_seeds(list(total))], list(total.values()))

    rows = docs.select("text", "lang").mapInArrow(tidy(count), COUNTS)
    return rows.groupBy("lang", "k", *WORDS).agg(F.sum("n").alias("n"))


SECOND = 1 << 32  # between the salts of a word's two hashes


def word_texts(docs: DataFrame, wanted: PhraseFilter, salt: int) -> DataFrame:
    """(w, lang, word) of the words in a filter."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names, codes, seeds = _languages(batch.column(1))
            for block in text_blocks(batch.column(0), BLOCK):
                s = Segments(block, seeds[block.first:block.first + len(block)], salt)
                at = np.flatnonzero(wanted.has(s.h1))
                at = at[np.unique(s.h1[at], return_index=True)[1]]
                view = s.data.tobytes()
                for i, w in zip(at.tolist(), s.h1[at].view(np.int64).tolist()):
                    if w not in held:
                        held[w] = (names[codes[block.first + s.owner[i]]], view[s.start[i]:s.end[i]].decode())
                if len(held) > HELD // 2:
                    yield _words_found(held)
                    held = {}
        if held:
            yield _words_found(held)

    return docs.select("text", "lang").mapInArrow(tidy(look), "w long, lang string, word string").distinct()


def _words_found(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.string()),
         pa.array([x[1] for x in held.values()], pa.string())], names=["w", "lang", "word"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def proposals(docs: DataFrame, min_count: int, longest: int, sample: int, slack: float, salt: int = 0) -> DataFrame:
    """(k, w1, ...) of the phrases that the sample finds frequent, shorter runs first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    part = stored(rows.where(F.expr(f"pmod(xxhash64(doc_id, text), {sample}) = 0")).select("text", "lang"), "phrase-sample")
    least = max(1, int(slack * min_count / sample))
    found = []
    for shortest, last in ((1, 1), (2, 2), (3, longest)):
        if shortest > longest:
            break
        known = [PhraseFilter.of(_union(found))] if found else []
        counts = run_counts(part, shortest, min(last, longest), known, shortest - 1, salt=salt)
        found.append(stored(_phrases(counts.where(f"k > 0 and n >= {least}")).drop("n"), "proposed"))
    return _union(found)


def _phrases(counts: DataFrame) -> DataFrame:
    """(k, w1, ...); what a single word carries besides is no part of the phrase."""
    return counts.select("k", *[F.when(F.lit(j == 0) | (F.col("k") > 1), F.col(w)).otherwise(0).alias(w) for j, w in enumerate(WORDS)], *(["n"] if "n" in counts.columns else []))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sample: int = SAMPLE,
         slack: float = SLACK, salt: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """((k, w1, ..., f) of every frequent phrase of 1 to ``longest`` words, (first,
    lang, n) the language of every frequent word and its number of words, the
    salt of the word hashes); all counts exact."""
    if not 1 <= longest <= WIDTH:
        raise ValueError(f"phrases have 1 to {WIDTH} words, not {longest}")
    proposed = proposals(docs, min_count, longest, sample, slack, salt)
    texts = _texts(docs)
    guess = PhraseFilter.of(proposed)
    # single words all stay: a rare one can share its hash, too
    every = stored(run_counts(texts, 1, longest, [guess], longest, salt=salt).where(f"k < 2 or n >= {min_count}"), "run-counts")
    double = every.where("k = 1").groupBy("w1").agg(F.count(F.lit(1)).alias("words")).where("words > 1")
    if not double.isEmpty():  # two words with one hash
        return mine(docs, min_count, longest, sample, slack, salt + 1)
    counts = stored(_phrases(every.where(f"k > 0 and n >= {min_count}")).withColumnRenamed("n", "f"), "phrases")
    failures = counts.where(f"k < {longest}").join(proposed, ["k", *WORDS], "left_anti")
    if not failures.isEmpty():
        more = run_counts(texts, 2, longest, [guess, PhraseFilter.of(counts)], longest, expand=True, salt=salt)
        more = more.where(f"n >= {min_count}").select("k", *WORDS, F.col("n").alias("f"))
        counts = counts.union(stored(more, "phrase-expansion"))
    totals = every.where("k = 0").select("lang", "n", F.col("w1").alias("seed"))
    firsts = every.where(f"k = 1 and n >= {min_count}").select(F.col("w1").alias("first"), F.col("w3").alias("seed"))
    return counts, firsts.join(totals, "seed").select("first", "lang", "n"), salt


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 sample: int = SAMPLE, slack: float = SLACK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases per language."""
    found, firsts, salt = mine(docs, min_count, longest, sample, slack)
    found = found.select("k", F.array(*WORDS).alias("w"), "f")
    part = lambda lo, size: F.slice("w", lo, size)
    pad = lambda p, size: F.concat(p, F.array_repeat(F.lit(0).cast("long"), WIDTH - size))
    phrase = found.where("k > 1")
    # a longer phrase that is as frequent has one part of one word less that is as frequent, too
    inner = (phrase.where("k > 2").select("f", F.explode(F.array(
        pad(part(F.lit(1), F.col("k") - 1), F.col("k") - 1), pad(part(F.lit(2), F.col("k") - 1), F.col("k") - 1))).alias("w"))
        .groupBy("w").agg(F.max("f").alias("most")))
    able = phrase.join(inner, "w", "left").where("most is null or most < f").select("k", "w", F.col("f").alias("a"))
    cuts = (able.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("k", "w", "a", "cut", pad(part(F.lit(1), F.col("cut")), F.col("cut")).alias("head"),
                    pad(part(F.col("cut") + 1, F.col("k") - F.col("cut")), F.col("k") - F.col("cut")).alias("tail")))
    cuts = (cuts.join(found.select(F.col("w").alias("head"), F.col("f").alias("l")), "head")
            .join(found.select(F.col("w").alias("tail"), F.col("f").alias("r")), "tail")
            .join(firsts, F.col("w")[0] == F.col("first")))  # a word's hash goes with its language
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(1000 * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    best = (cuts.withColumn("score", score).groupBy("lang", "k", "w", "a", "n")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
            .select("lang", "k", "w", "a", "x.l", "x.r", "n", "x.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stored(best.withColumn("place", F.rank().over(order)).where(f"place <= {top}"), "best-phrases")  # with what ties the last
    # texts of their words, put together by place
    each = first.select("w", "k", F.posexplode("w").alias("at", "one")).where("at < k")
    words = word_texts(_texts(docs), PhraseFilter.of(each.select(F.lit(1).alias("k"), *_single("one")).distinct()), salt)
    spelled = (each.join(words.select(F.col("w").alias("one"), "word"), "one").groupBy("w")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (first.join(spelled, "w").withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {top}")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _single(word: str) -> list:
    """Columns w1, ... of a phrase of one word."""
    return [F.expr(word).alias("w1")] + [F.lit(0).cast("long").alias(w) for w in WORDS[1:]]


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle_sql(min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> str:
    """All runs counted outright."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
segments AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM segments),
runs AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM starts, range(1, {longest + 1}) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM runs GROUP BY lang, phrase HAVING count(*) >= {min_count}),
totals AS (SELECT lang, sum(len(w)) AS n FROM segments GROUP BY lang),
inner_runs AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, f
  FROM f, range(1, {longest + 1}) AS a(i), range(2, {longest}) AS b(m) WHERE m < k AND i + m - 1 <= k),
able AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
  SELECT 1 FROM inner_runs x WHERE x.lang = f.lang AND x.phrase = f.phrase AND 100 * x.f >= 100 * f.f)),
cuts AS (
  SELECT able.lang, able.phrase, able.f AS a, cut, p.f AS l, q.f AS r, n,
         (1000 * able.f::HUGEINT * n::HUGEINT) // (p.f::HUGEINT * q.f::HUGEINT) AS score
  FROM able JOIN range(1, {longest}) AS t(cut) ON cut < able.k
  JOIN f p ON p.lang = able.lang AND p.phrase = array_to_string(string_split(able.phrase, ' ')[1:cut], ' ')
  JOIN f q ON q.lang = able.lang AND q.phrase = array_to_string(string_split(able.phrase, ' ')[cut + 1:able.k], ' ')
  JOIN totals ON totals.lang = able.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
       a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= {top}"""
