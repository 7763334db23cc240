import random
import re

import numpy as np

from marketframe.llm import mixing

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """sizes: source -> words; share by weight, stop at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check(rows, got):
    """rows: (doc_id, text, source) with distinct ids; got: doc_id -> row."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    total = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    target = brute_targets(total)
    taken = dict.fromkeys(total, 0)
    for d, _, s in rows:
        r = got[d]
        assert r["size"] == size[d] and r["source_size"] == total[s]
        assert abs(r["target"] - target[s]) <= 1e-6 * max(1, target[s])
        assert r["taken"] <= 3 * size[d] and (r["taken"] == 0 if size[d] == 0 else r["taken"] % size[d] == 0)
        taken[s] += r["taken"]
    return taken, target


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = {r["doc_id"]: r for r in mixing.op2_mixing(spark, SF).collect()}
    assert len(got) == len(rows)
    taken, target = check(rows, got)
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    again = {r["doc_id"]: r["taken"] for r in mixing.op2_mixing(spark, SF).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}


def test_caps_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 5, 5, 9])), rng.choice(["a", "b", "ü", "Z", None])) for i in range(400)]
    rows += [(1000, "only one here", "tiny"), (1001, None, "empty"), (1002, "", None), (1003, " \n", "a")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    taken, target = check(rows, got)
    assert got[1000]["target"] == 9.0 and taken["tiny"] == 9 and got[1001]["target"] == 0.0
    assert all(abs(taken[s] - target[s]) <= 5 for s in taken)
    out = mixing.select_rows(df)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {d: r["taken"] // r["size"] for d, r in got.items() if r["taken"]}


def test_selection_over_hash_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 10)
    rows = [(i, "five words are in here", "a" if i % 2 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = check(rows, {r["doc_id"]: r for r in mixing.mix(df).collect()})
    assert all(abs(taken[s] - target[s]) <= 5 for s in taken)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c", "x")] * 7 + [(1, "a b", "y")] * 3 + [(2, "a b c d", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert mixing.select_rows(df).count() == sum(r["taken"] // r["size"] for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.select_rows(df).collect() == []


def test_fit_rest_is_a_subset_and_close():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 3000, rng.integers(1, 40)))
        counts = rng.integers(1, 30, len(lengths))
        total = int((lengths * counts).sum())
        rest = int(rng.integers(0, total + 1))
        take = mixing.fit_rest(lengths, counts, rest)
        assert (take >= 0).all() and (take <= counts).all()
        reach = {0}
        if total < 4000:  # brute force on small cases
            for n, c in zip(lengths, counts):
                reach = {s + n * k for s in reach for k in range(c + 1)}
            best = min(abs(s - rest) for s in reach)
            assert abs(int((lengths * take).sum()) - rest) <= max(best, int(lengths.min()))
        assert abs(int((lengths * take).sum()) - rest) <= lengths.max()


def test_extra_columns_with_the_names_of_helpers(spark):
    from marketframe.llm import mixing
    names = ["_id", "_hash", "_times", "ID", "hash", "times", "rows", "nth", "n", "copy", "own_hash"]
    rows = [(k, "some words here", "s", *[f"{n}{k}" for n in names]) for k in (1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.select_rows(df)
    taken = sum(r.taken for r in mixing.mix(df).collect())
    assert out.columns == df.columns and 3 * out.count() == taken > 0
    assert {tuple(r) for r in out.collect()} <= set(rows)
