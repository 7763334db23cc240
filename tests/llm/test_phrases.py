import random
import re
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import phrases
from marketframe.llm.common import chained, span_hashes

FEW = "doc_id long, text string, lang string"


def expected(rows, min_count, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= min_count}
    out = {}
    for (lang, p), a in often.items():
        if len(p) == 1 or any(q[0] == lang and len(q[1]) > len(p) and c >= a and
                              any(q[1][i:i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, c in often.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    return {(lang, i + 1, *r) for lang, x in out.items()
            for i, r in enumerate(sorted(x, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top])}


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "Zürich", "x" * 1100, "a-b", "ß"] + [f"w{k}" for k in range(25)]
    fixed = [" ".join(rng.choices(vocabulary, k=rng.randrange(2, 8))) for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        text = "".join(x + rng.choice((" ", " ", " ", "\t ", ", ", ".\n", "?! ")) for x in words)
        rows.append((i, text, rng.choice(("en", "en", "de", None, "und"))))
    rows.append((n, "same " * 300, "en"))  # frequent in one document only
    return rows


def got(df, **k):
    return {tuple(r) for r in phrases.collocations(df, **k).collect()}


@pytest.mark.parametrize("sample, slack", [(1, 1.0), (8, 0.3), (10**9, 0.3)])
def test_any_sample_gives_the_exact_result(spark, sample, slack):
    rows = corpus(5)
    df = spark.createDataFrame(rows, FEW).repartition(4)
    assert got(df, min_count=10, sample=sample, slack=slack) == expected(rows, 10)


def test_top_and_shorter_phrases(spark):
    rows = corpus(6, 120)
    df = spark.createDataFrame(rows, FEW)
    for longest, top in ((2, 5), (3, 2000)):
        assert got(df, min_count=6, longest=longest, top=top) == expected(rows, 6, longest, top)


def test_defined_cases(spark):
    rows = [(None, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "a b", None), (3, "a b", None), (4, "A  b a\tB", "und"),
            (5, "a, b. a; b", "und")]
    df = spark.createDataFrame(rows, FEW).selectExpr("*", "1 as h", "2 as k", "'x' as phrase", "3 as n")
    assert got(df, min_count=3) == expected(rows, 3) == {("und", 1, "a b", 4, 6, 6, 12, 1333)}
    assert got(df.limit(0)) == set()


def test_products_beyond_64_bits(spark):
    """The score's decimals at counts of 10 ** 13, against whole numbers."""
    a, n, l, r = 10**13 - 7, 9 * 10**13 + 1, 10**13 - 3, 10**13 - 5
    text = "(1000 * cast({}L as decimal(19, 0)) * cast({}L as decimal(19, 0))) div (cast({}L as decimal(19, 0)) * cast({}L as decimal(19, 0)))"
    assert spark.sql("select " + text.format(a, n, l, r)).first()[0] == 1000 * a * n // (l * r)


def test_equal_hashes_are_told_apart_by_words():
    tally = phrases.Tally()
    zero, a, b = np.zeros(4, np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([5, 5, 5, 6], np.uint64)
    assert list(tally.add(2, zero, [a, b])) == []
    [(k, words, n)] = tally.rest()
    total = Counter()
    for x, y, c in zip(*map(np.ndarray.tolist, words), n.tolist()):
        total[x, y] += c
    assert k == 2 and total == {(1, 5): 2, (2, 5): 1, (1, 6): 1}


def test_two_words_with_one_hash_start_again_with_another_salt(spark, monkeypatch):
    rows = corpus(7, 60)
    df = spark.createDataFrame(rows, FEW)
    plain, salts = phrases.run_counts, []

    def clash(docs, *a, **k):
        salts.append(k["salt"])
        out = plain(docs, *a, **k)
        same = out.where("k = 1").orderBy("w1").limit(1).withColumn("w2", F.col("w2") + 1 - 2 * F.signum("w2").cast("long"))
        return out.union(same) if k["salt"] == 0 else out

    monkeypatch.setattr(phrases, "run_counts", clash)
    assert got(df, min_count=8) == expected(rows, 8) and set(salts) == {0, 1}


def test_salts_give_other_hashes():
    raw = np.frombuffer(b"word" + b"longer-than-eight" + b"x" * 2000, np.uint8)
    start, end = np.array([0, 4, 21]), np.array([4, 21, 2021])
    assert len({int(h) for salt in (0, 1, 2) for h in span_hashes(raw, start, end, salt)}) == 9


def test_filter_never_misses(spark):
    rng = np.random.default_rng(1)
    words = [[int(x) for x in rng.integers(-2**63, 2**63 - 1, 5)] for _ in range(3000)]
    rows = [(1 + i % 5, *w[:1 + i % 5], *[0] * (4 - i % 5)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k int, w1 long, w2 long, w3 long, w4 long, w5 long")
    w = np.array([r[1:] for r in rows], np.int64).view(np.uint64)
    h = []
    for i, r in enumerate(rows):
        x = w[i, :1]
        for j in range(1, r[0]):
            x = chained(x, w[i, j:j + 1])
        h.append(x[0])
    h = np.array(h, np.uint64)
    for bits in (8, 16, 26):
        f = phrases.PhraseFilter.of(df, bits)
        assert f.has(h).all()
    assert f.has(rng.integers(0, 2**63, 100_000).astype(np.uint64)).mean() < 0.01


def test_tally_in_small_memory():
    tally, total = phrases.Tally(limit=50), Counter()
    rng = np.random.default_rng(2)
    want = Counter()
    for _ in range(40):
        h = rng.integers(0, 200, 30).astype(np.uint64)
        want.update(h.tolist())
        for k, (x,), c in tally.add(1, h, [h]):
            total.update(dict(zip(x.tolist(), c.tolist())))
    for k, (x,), c in tally.rest():
        total.update(dict(zip(x.tolist(), c.tolist())))
    assert total == want


def test_tally_holds_little_and_emits_small_batches():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 2**63, (3, 50_000)).astype(np.uint64) for _ in range(24)]
    tally, rows, most = phrases.Tally(), 0, 0
    tracemalloc.start()
    for h, a, b in blocks:
        for k, _, n in tally.add(2, h, [a, b]):
            rows, most = rows + len(n), max(most, len(n))
    for k, _, n in tally.rest():
        rows, most = rows + len(n), max(most, len(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 24 * 50_000 and most <= 1 << 15 and peak < 60 << 20


def test_rare_runs_are_not_stored(spark, monkeypatch):
    rows, kept, plain = corpus(8, 60), {}, phrases.stored

    def store(df, kind):
        kept[kind] = plain(df, kind)
        return kept[kind]

    monkeypatch.setattr(phrases, "stored", store)
    assert got(spark.createDataFrame(rows, FEW), min_count=8) == expected(rows, 8)
    assert kept["run-counts"].where("k > 1 and n < 8").isEmpty()
    assert not kept["run-counts"].where("k = 1 and n < 8").isEmpty()
