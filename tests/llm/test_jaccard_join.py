import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from marketframe.llm import jaccard_join as J
from marketframe.llm.jaccard_join import jaccard_components, one_of_each, op10_jaccard_join

SCHEMA = "doc_id long, text string, sig string, n string, comp int"


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def want(rows):
    return sorted(brute.jaccard_components(rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op10_jaccard_join(spark, sf)) == want(rows)


@pytest.mark.parametrize("seed", range(2))
def test_edited_copies_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [f"hot{i}" for i in range(40)]
    rows = []
    for k in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 60))]
        for c in range(12):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.4:
                copy += passage
            rows.append((len(rows) * 3, " ".join(copy)))
    rng.shuffle(rows)
    assert got(jaccard_components(frame(spark, rows))) == want(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (None, "one two"), (2, "One  TWO"), (9, "one\ntwo"), (7, "a b c d e f"),
            (7, "a b c d e f"), (None, "lonely text here"), (None, None), (11, long), (12, long + " tail"), (1, "É b"), (0, "é b")]
    assert got(jaccard_components(frame(spark, rows))) == want(rows)


def test_empty_table(spark):
    assert got(jaccard_components(frame(spark, []))) == []


def test_one_of_each_with_repeated_and_null_ids(spark):
    near = [f"n{i}" for i in range(60)]
    rows = [(7, "a first text that shares no word"), (7, "quite another one with different terms"), (7, "quite another one with different terms"),
            (None, " ".join(near)), (None, " ".join([*near, "tail"])), (None, "by itself here"), (None, "")]
    left = [(r["doc_id"], r["text"]) for r in one_of_each(frame(spark, rows)).collect()]
    copies = [t for d, t in left if t.startswith("n0 ")]
    assert len(copies) == 1
    rest = sorted(((d, t) for d, t in left if not t.startswith("n0 ")), key=str)
    assert rest == sorted([rows[0], rows[1], rows[5], rows[6]], key=str)


def test_extra_columns_with_the_names_of_helpers(spark):
    names = ["_id", "_text", "stays", "_th", "ID", "th", "own_hash", "n", "shard"]
    rows = [(1, "a b c d e f g", *[f"x{k}" for k in range(9)]), (2, "a b c d e f g", *[f"y{k}" for k in range(9)]), (3, "q r s t u v w", *[f"z{k}" for k in range(9)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = J.one_of_each(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_shingles_that_agree_in_32_bits_all_count():
    """Two classes share three shingles, two of them alike in the low bits."""
    def row(doc, low):
        low = np.sort(np.array(low, np.uint32))
        return {"part": 0, "docs": np.array([doc], "<i8").tobytes(), "local": np.zeros(1, "<u4").tobytes(), "single": J._planes(low),
                "owner": np.zeros(len(low), "<u2").tobytes(), "common": b"", "meta": np.zeros((5, 0), "<i8").tobytes()}
    group = pa.Table.from_pylist([row(1, [7, 7, 9]), row(2, [7, 7, 9, 11]), row(1, [7, 7, 9])], schema=J._PACKED)
    facts = {r["sig"]: r["shared"] for r in J._part_facts(group).to_pylist() if r["kind"] == 1}
    assert facts == {1: 3, 2: 3}


def test_packed_shingles_leave_in_small_sets(spark):
    """A task holds few batches and shingles at a time, since executors share memory with their workers."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat_ws("x", F.col("id"), i)))
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"size": b.nbytes}])

    assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 5 << 20
    packed = J.packed_shingles(docs, 2, J.WORDS).where("part = 0").select(F.length("single")).collect()
    assert len(packed) >= 3 and sum(r[0] for r in packed) > 4 * 400_000
