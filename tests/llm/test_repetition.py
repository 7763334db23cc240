import random
import re
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from marketframe.llm import common, repetition

FEW = "doc_id long, text string"


def repeated_words(w, k):
    at = defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i:i + k])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def maximal_repeats(w, least):
    """All substrings of at least ``least`` words that occur twice or more and
    cannot be extended to either side at all occurrences."""
    out = {}
    for k in range(least, len(w)):
        at = defaultdict(list)
        for i in range(len(w) - k + 1):
            at[tuple(w[i:i + k])].append(i)
        for s, v in at.items():
            left = {w[i - 1] if i else ("start",) for i in v}
            right = {w[i + k] if i + k < len(w) else ("end",) for i in v}
            if len(v) > 1 and len(left) > 1 and len(right) > 1:
                out[s] = v
    return out


def expected(text, least=repetition.MIN_REPEAT):
    text = text or ""
    w = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    found = maximal_repeats(w, least)
    cover = {j for s, v in found.items() for i in v for j in range(i, i + len(s))}
    longest = max(map(len, found), default=0)
    n = len(w)
    again = repeated_words(w, 8)
    failed = n < 20 or 100 * again > 30 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again, failed,
            not failed and 100 * len(cover) <= repetition.COVERED * n and longest <= repetition.LONGEST,
            len(found), len(cover), longest)


def check(spark, rows):
    got = repetition.quality(spark.createDataFrame(rows, FEW)).collect()
    assert [tuple(r) for r in got] == [(d, *expected(t)) for d, t in rows]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = [f"w{k}" for k in range(rng.choice((1, 2, 3, 8, 200)))]
        w = [rng.choice(letters) for _ in range(rng.randrange(90))]
        if rng.random() < 0.5 and len(w) > 12:
            cut = rng.randrange(3, 12)
            w[rng.randrange(len(w)):0] = w[:cut]
        yield "".join(x + rng.choice((" ", " ", "\n", "\t\n ")) for x in w)


def test_random_texts_against_all_substrings(spark):
    check(spark, [(i, t) for i, t in enumerate(texts(1, 300))])


def test_defined_cases(spark):
    line = "ein Satz mit genau zehn Wörtern steht hier für immer"
    check(spark, [(None, None), (1, ""), (1, ""), (2, " \n\n"), (3, "ü # é"), (4, "a " * 60), (5, "\n".join([line] * 3)),
                  (6, " ".join(f"x{i}" for i in range(30))), (7, "same\nsame \nsame\n\n\nsame"), (8, "<b>&amp;</b> 100% #1")])


def test_long_text(spark):
    w = [f"w{i}" for i in range(30_000)]
    out = repetition.quality(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:15_000] * 2)), (3, "a " * 50_000)], FEW)).collect()
    assert [(r.n_words, r.covered_words, r.longest_repeat, r.n_repeats, r.kept) for r in out] == [
        (30_000, 0, 0, 0, True), (30_000, 30_000, 15_000, 1, False), (50_000, 50_000, 49_999, 49_999 - repetition.MIN_REPEAT + 1, False)]


def test_longest_repeat_alone_fails(spark):
    twice = [f"p{i}" for i in range(repetition.LONGEST + 1)]
    w = twice + [f"x{i}" for i in range(1000)] + twice
    [row] = repetition.quality(spark.createDataFrame([(1, " ".join(w))], FEW)).collect()
    assert not row.base_failed and not row.kept and row.longest_repeat == len(twice)


def test_repeats_do_not_cross_texts():
    t = " ".join(f"a{i}" for i in range(40))
    [block] = common.text_blocks(pa.array([t, t]))
    m = repetition.measures(block)
    assert m["n_repeat_words"].tolist() == [0, 0] == m["covered_words"].tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_windows_of_any_size(size):
    rng = np.random.default_rng(size)
    word = rng.integers(0, 2, 200)
    owner = np.repeat([0, 1], 100)
    group = repetition.SuffixArray(word, owner).windows(size)
    seen = {}
    for i in range(200):
        full = i + size <= (100 if i < 100 else 200)
        key = (owner[i], tuple(word[i:i + size])) if full else None
        if key is None:
            assert group[i] == -1
        else:
            assert seen.setdefault(key, group[i]) == group[i]
    assert len(set(seen.values())) == len(seen)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id int, text string, n_words int, kept string")
    assert [r.n_words for r in repetition.quality(df).collect()] == [2]
    assert repetition.quality(df.limit(0)).collect() == []


def test_base_columns_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in repetition.quality(df).collect():
        t = text[r.doc_id] or ""
        w = brute.WORD.findall(t)
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeated_words(w, 8))
