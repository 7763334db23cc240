import pytest

from marketframe.llm import sharding
from oracle import duck

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_bytes", "shard", "depth", "page"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limit", [sharding.LIMIT_BYTES, 300_000, 9_000])
def test_equals_sql(spark, limit):
    got = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit)
    want = duck(SF).execute(f"SELECT {', '.join(COLUMNS)} FROM ({sharding.oracle_sql(limit)})").fetchall()
    assert rows(got) == sorted(want, key=str)


def test_directory_is_prefix_free_and_within_the_limit(spark):
    limit = 20_000
    table = sharding.directory(sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit)).collect()
    assert all(r["bytes"] <= limit or r["docs"] == 1 for r in table)
    names = sorted({r["shard"] for r in table})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert all(len(r["shard"]) == r["depth"] for r in table)


def test_edges(spark):
    data = [(1, None, 0), (2, "", 0), (None, "abc", 0), (3, "x" * 500, 0), (4, "é" * 10, 0)] + [(9, "same text", 0)] * 50
    df = spark.createDataFrame(data, "doc_id long, text string, shard int")
    out = sharding.shards(df, 40).collect()
    assert len(out) == len(data)
    sums = {}
    for r in out:
        sums.setdefault((r["shard"], r["page"]), []).append(r["n_bytes"])
    assert all(sum(v) <= 40 or len(v) == 1 for v in sums.values())
    same = [r for r in out if r["doc_id"] == 9]
    assert len(same) == 50 and len({r["shard"] for r in same}) == 1 and len({r["page"] for r in same}) == 13


def test_empty_table(spark):
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents_are_never_the_broadcast_side(spark, monkeypatch):
    plans = []
    plain = sharding.stored

    def spy(df, kind):
        if kind == "placed":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, kind)

    monkeypatch.setattr(sharding, "stored", spy)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.shards(docs, 2_000)
    assert "BroadcastHashJoin" in plans[0] and "BuildLeft" not in plans[0]
    assert len(plans) > 1 and all("SortMergeJoin [substring(key" in p for p in plans[1:])
