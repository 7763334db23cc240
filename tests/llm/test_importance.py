import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from marketframe.llm import importance

FEW = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, longest):
    w = WORD.findall(brute.lower_ascii(text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, other = Counter(), Counter()
    for _, t in rows:
        own.update(map(bucket, runs_of(t, longest)[1]))
    for t in target:
        other.update(map(bucket, runs_of(t, longest)[1]))
    s_all, t_all = sum(own.values()), sum(other.values())
    out = []
    for i, (d, t) in enumerate(rows):
        w, f = runs_of(t, longest)
        weight = sum(math.floor(1000 * math.log((other[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["Straße", "été", "x" * 70, "İ", "I9"]
    rows = [(rng.randrange(-10**6, 10**6), " ".join(rng.choices(vocabulary, k=rng.randrange(60))) + rng.choice(("", ".", "!\n"))) for _ in range(400)]
    return rows, [" ".join(rng.choices(vocabulary[:50], k=30)) for _ in range(10)]


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, corpus, longest):
    rows, target = corpus
    out = importance.resample(spark.createDataFrame(rows, FEW).repartition(5),
                              spark.createDataFrame([(0, t) for t in target], FEW), longest=longest)
    assert ordered(out.collect()) == ordered(expected(rows, target, longest=longest))


def test_defined_cases(spark):
    long_text = "word " * 50_000
    rows = [(None, "a b " * 12), (None, None), (5, ""), (5, "a b c " * 10), (7, long_text),
            (-(2**63), "q " * 25), (2**63 - 1, "q " * 25), (1, "z " * 19), (2, "z " * 20)]
    df = spark.createDataFrame(rows, FEW).selectExpr("*", "1 as block", "2 as at", "'x' as digit", "3 as rank")
    out = importance.resample(df, spark.createDataFrame([(1, "q q z")], FEW), percent=100)
    assert ordered(out.collect()) == ordered(expected(rows, ["q q z"], percent=100))


def test_repeated_rows_and_ids_take_different_ranks(spark):
    rows = [(1, "a " * 20)] * 30 + [(2, "a " * 20)] * 10
    out = importance.resample(spark.createDataFrame(rows, FEW).repartition(7), spark.createDataFrame([(1, "a")], FEW), percent=50)
    assert sorted(r.rank for r in out.collect() if r.rank) == list(range(1, 21))


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], FEW)
    assert importance.resample(none, none).collect() == []
    rows, _ = corpus
    assert ordered(importance.resample(spark.createDataFrame(rows, FEW), none).collect()) == ordered(expected(rows, []))
    few = [(k, "a " * 30) for k in range(9)]
    assert {r.rank for r in importance.resample(spark.createDataFrame(few, FEW), none).collect()} == {None}


def test_crc32_of_spans_goes_on():
    raw = b"".join(bytes([i % 251]) * (i % 90 + 1) for i in range(200))
    size = np.array([i % 90 + 1 for i in range(200)])
    end = np.cumsum(size)
    data = np.frombuffer(raw, np.uint8)
    got = importance.crc32_spans(data, end - size, end)
    assert got.tolist() == [zlib.crc32(raw[e - s:e]) for s, e in zip(size, end)]
    more = importance.crc32_spans(data, end - size, end, got)
    assert more.tolist() == [zlib.crc32(raw[e - s:e], int(c)) for s, e, c in zip(size, end, got)]


@pytest.mark.parametrize("block_limit", [1, 7, 1 << 18])
def test_radix_sort_is_stable_for_any_block_size(spark, monkeypatch, block_limit):
    monkeypatch.setattr(importance, "BLOCK_ROWS", block_limit)
    rng = random.Random(block_limit)
    rows = [(k // 10, k % 10, rng.choice((0, 1, 3, 70_000)), rng.randrange(3)) for k in range(60)]
    df = spark.createDataFrame(rows, "block long, at long, a long, b long")
    out = importance.radix_ranks(df.select("block", "at", "a", "b", F_id(df)), [("b", 2), ("a", 17)], len(rows), 4)
    got = [r.row for r in sorted(out.collect(), key=lambda r: r.rank)]
    assert got == [10 * x[0] + x[1] for x in sorted(rows, key=lambda x: (x[2], x[3], x[0], x[1]))]


def F_id(df):
    return (df.block * 10 + df["at"]).alias("row")
