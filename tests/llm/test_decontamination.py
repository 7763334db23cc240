import random

from marketframe.llm import decontamination as D

SF = "/root/testdata/sf0.01"


def brute_align(a, b):
    """Textbook local alignment score."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (D.MATCH if x == y else D.MISMATCH), row[j + 1] + D.GAP, new[j] + D.GAP))
        row = new
        best = max(best, max(row))
    return best


def test_alignment_equals_textbook():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(0, 20))]
        score, lo, hi = D.align(a, b)
        assert score == brute_align(a, b)
        assert brute_align(a, b[lo:hi]) == score


def test_whole_table_equals_alignment_of_all_pairs(spark):
    docs = {r[0]: D._words(r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = {r[0]: D._words(r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.op5_decontamination(spark, SF).collect()}
    grams = {i: set(zip(w, w[1:], w[2:])) for i, w in items.items()}
    want = {}
    for d, w in docs.items():
        held = set(zip(w, w[1:], w[2:]))
        for i, g in grams.items():
            if len(g & held) >= 1:
                score = D.align(items[i], w)[0] / (D.MATCH * len(items[i]))
                if score >= D.THRESHOLD:
                    want[d, i] = score
    assert got == want and len(want) > 10


def test_edited_copies_are_caught_and_clean_texts_left(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(35))) for i in range(20)]
    docs, leaked = [], set()
    for k in range(120):
        text = [word() for _ in range(rng.randrange(5, 200))]
        if k % 3 == 0:
            copy = items[k % 20][1].upper().split()
            for _ in range(4):
                copy[rng.randrange(len(copy))] = word()
            del copy[rng.randrange(len(copy))]
            at = rng.randrange(len(text))
            text[at:at] = copy
            leaked.add((k, k % 20))
        docs.append((k, "  ".join(text), 1))
    docs += [(900, None, 1), (901, "", 1), (None, items[0][1], 1), (902, items[1][1], 1), (902, items[1][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "two words"), (53, items[1][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()}
    same = {(d, 53) for d, i in leaked if i == 1}  # item 53 has the text of item 1
    assert got == leaked | same | {(None, 0), (902, 1), (902, 53)}
    stay = [r["doc_id"] for r in D.clean(df, bench).collect()]
    assert sorted(stay) == sorted({d for d, _, _ in docs if d is not None} - {d for d, _ in got})
    assert D.clean(df, bench).columns == df.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert D.contaminated(none, bench).collect() == []
    assert D.contaminated(one, bench.limit(0)).collect() == []
    assert len(D.contaminated(one, bench).collect()) == 1


def test_regular_edits_next_to_an_exact_copy(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(n, " ".join(word() for _ in range(n))) for n in (16, 25, 38, 59)]
    docs = [(n, text) for n, text in items]
    for n, text in items:
        for step in (4, 5, 6):
            for offset in range(step):
                copy = [word() if k % step == offset else w for k, w in enumerate(text.split())]
                docs.append((1000 * n + 10 * step + offset, " ".join([word() for _ in range(9)] + copy + [word() for _ in range(9)])))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    scores = {(d, i): D.align(D._words(a), D._words(t))[0] / (D.MATCH * len(D._words(a))) for d, t in docs for i, a in items}
    assert got == {pair: s for pair, s in scores.items() if s >= D.THRESHOLD} and len(got) == 64


def test_no_alignment_matches_more_than_the_shared_words():
    """The bound before the alignment: score <= shared words / words of the item."""
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(1, 14))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 25))]
        assert D.align(a, b)[0] <= D.MATCH * D.shared_words(a, b)


def test_long_items_do_not_widen_the_passages_of_short_ones(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    short, long = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(4000))
    text = [word() for _ in range(60_000)]
    text[30_000:30_000] = short.split()
    docs = [(1, " ".join(text)), (2, " ".join(text[:500] + long.split()[:2600] + text[500:900]))]
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "xxhash64(text) text_hash")
    seeds = D.item_grams(items.withColumnRenamed("item_id", "item"))
    size = {r.doc_id: len(r.text.split()) for r in D.passages(df, D.blooms(seeds)).collect()}
    assert size[1] < 200 and size[2] == 500 + 2600 + 400
    got = {(r.doc_id, r.item_id, r.score) for r in D.contaminated(df.drop("text_hash"), items).collect()}
    assert got == {(1, 1, 1.0), (2, 2, 0.65)}


def test_frequent_seeds_meet_many_items_and_lose_none(spark):
    """One line is part of every item and of every document."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(5)]
    items = [(i, " ".join([word() for _ in range(6)] + line + [word() for _ in range(6)])) for i in range(15)]
    docs = []
    for k in range(90):
        own = items[k % 15][1].split() if k % 9 == 0 else line
        docs.append((k, " ".join([word() for _ in range(20)] + own + [word() for _ in range(20)])))
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    scores = {(d, i): D.align(D._words(a), D._words(t))[0] / (D.MATCH * len(D._words(a))) for d, t in docs for i, a in items}
    assert got == {p: s for p, s in scores.items() if s >= D.THRESHOLD} and len(got) == 10


def test_extra_columns_with_the_names_of_helpers(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "other words", 5, 6)], "doc_id long, text string, _hash long, HASH long")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert [tuple(r) for r in D.clean(df, bench).collect()] == [(2, "other words", 5, 6)]
