import hashlib

import brute
from marketframe.llm.personal_data import bootstrap, base_spans, op7_personal_data, personal_data

KINDS = ("email", "ip", "card", "phone")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")


def base(df):
    return {r["doc_id"]: [(KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op7_personal_data(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, text in docs.items():
        spans = brute.personal(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), d
        assert [got[d][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert set(line.split(",")) - {""} <= set(got[d]["spans"].split(","))


def test_odd_texts(spark):
    texts = [None, "", "a@b.c@d.e x@y a@b.c_d@e.f.g-h é@b.co x.a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 0000300.1.1.1 999999999999999999999.1.1.1",
             "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 34", "4111  1111 1111 1111", "+1 (988) 555-2485 +123 +1(2)3-4.5 6 7 8 9 0+491234567890",
             "😀 ü a@b.cd 😀 10.0.0.1", "9 " * 30_000, "a" * 20_000 + "@", "1" * 50_000 + ".1.1.1", "x@" + "a." * 20_000 + "b", "+" + "1 " * 20_000]
    got = base(personal_data(frame(spark, texts)))
    for i, t in enumerate(texts):
        assert got[i] == brute.personal(t), i


def test_long_run_before_an_at_sign(spark):
    texts = ["a" * 200_000 + "@", "a" * 200_000 + "@b.co"]  # spans by hand: the brute-force regex is quadratic here
    assert base(personal_data(frame(spark, texts))) == {0: [], 1: [("email", 0, 200_005)]}


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"please write to my mail address u{i}@host{i}.org today" for i in range(12)]
    texts += ["please write to my mail address bob9[at]host7 today", "the number 12345 is here", "plain words only"]
    rows = {r["doc_id"]: r["found"] for r in personal_data(frame(spark, texts)).collect()}
    at = texts[12].index("bob9")
    assert [(f["kind"], f["start"], f["end"]) for f in rows[12]] == [(0, at, at + len("bob9[at]host7"))]
    assert not rows[13] and not rows[14] and not rows[0]


def test_a_word_with_a_digit_to_the_left_is_context(spark):
    texts = [f"now send it to box9 u{i}@host{i}.org b7 today" for i in range(12)]
    texts += ["now send it to box9 bob9[at]host7 b7 today", "u0@a.bc u1@a.bc x9 y8 z7777"]
    facts = {r["doc_id"]: r for r in base_spans(frame(spark, texts)).collect()}
    around = lambda s: (s["l2"], s["l1"], s["r1"])
    assert around(facts[0]["base"][0]) == ("to", "box9", "b7")
    assert [around(s) for s in facts[12]["other"]] == [("it", "to", "bob9[at]host7"), ("to", "box9", "b7")]
    assert [around(s) for s in facts[13]["base"]] == [("", "", "u1@a.bc"), ("", "u0@a.bc", "x9")]
    assert [around(s) for s in facts[13]["other"]] == [("x9", "y8", "")]
    found = {r["doc_id"]: r["found"] for r in personal_data(frame(spark, texts)).collect()}
    at = texts[12].index("bob9")
    assert [(f["kind"], f["start"], f["end"]) for f in found[12]] == [(0, at, at + len("bob9[at]host7"))]


def test_empty_table(spark):
    assert personal_data(frame(spark, [])).collect() == []
