import numpy as np

from marketframe.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    net = L.Network(["a", "b", "c"], hidden=3)
    for owner, name in net.parameters():
        setattr(owner, name, getattr(owner, name).astype(np.float64))
    rng = np.random.default_rng(0)
    x = rng.integers(97, 105, (7, 5)).astype(np.uint8)
    valid = np.arange(7)[:, None] < np.array([7, 7, 5, 3, 1])
    y = rng.integers(0, 3, 5)
    _, grads = net.loss_and_gradients(x, valid, y)
    for (owner, name), g in zip(net.parameters(), grads):
        a = getattr(owner, name)
        for _ in range(10):
            i = (int(x[rng.integers(7), rng.integers(5)]), int(rng.integers(a.shape[1]))) if name == "w" else tuple(int(rng.integers(s)) for s in a.shape)
            old = a[i]
            a[i] = old + 1e-5
            up = net.loss_and_gradients(x, valid, y)[0]
            a[i] = old - 1e-5
            down = net.loss_and_gradients(x, valid, y)[0]
            a[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def test_held_out_accuracy(spark):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op9_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    docs = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", 0) for i in range(40)]
    docs += [(100, None, "en", 0), (101, "", "de", 0), (102, "12 345 !!", "en", 0), (None, "the cat", None, 0), (103, "the cat and " * 20_000, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in L.predicted(df).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert got[100]["score"] == 0.0 and got[None]["held_out"] is False
    none = L.predicted(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).collect()
    assert none[0]["lang_pred"] == "und"
    assert L.predicted(df.limit(0)).collect() == []
