"""The pipeline against plain Python decisions on each stage's own input."""

import brute
import corpus_pipeline as P
from marketframe.llm import decontamination, mixing, toxicity
from marketframe.llm.common import stored, table

SF = "/root/testdata/sf0.01"


def test_stages_on_their_own_inputs(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    one = stored(stages["toxicity"](spark, docs, SF), "t")
    bad = {r["doc_id"] for r in toxicity.scored(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert bad and {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - bad

    two = stored(stages["near_duplicates"](spark, one, SF), "t")
    rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in two.select("doc_id").collect()) == sorted({c for _, _, c in brute.jaccard_components(rows)})

    three = stored(stages["decontamination"](spark, two, SF), "t")
    leaked = {r["doc_id"] for r in decontamination.contaminated(two, table(spark, SF, "benchmark")).collect()}
    assert leaked and {r[0] for r in three.select("doc_id").collect()} == {r[0] for r in two.select("doc_id").collect()} - leaked

    four = stored(stages["mixing"](spark, three, SF), "t")
    assert four.count() == mixing.mix(three).where("taken > 0").selectExpr("sum(taken / size)").first()[0]
    assert all(x.columns == columns for x in (one, two, three, four))

    last = stages["sharding"](spark, four, SF)
    assert last.count() == four.count()
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", None, "s", 1, "x"), (1, "a b c d e f g", None, "s", 1, "x"), (2, "A b c d e f g", "en", None, 1, "x"),
            (None, None, None, None, None, "x"), (None, "", "en", "s", 0, "x"), (3, "other words stand in here", "en", "s", 1, "x"),
            (None, "other words stand in here", "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    out = dict(P.STAGES)["near_duplicates"](spark, df, SF)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == [
        (-1, ""), (-1, ""), (1, "a b c d e f g"), (3, "other words stand in here")]
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, df.limit(0), SF).collect() == [], name
        assert stage(spark, df, SF).columns == df.columns
    assert P.STAGES[-1][1](spark, df, SF).count() == len(rows)
