import random
import re

import numpy as np
import pyarrow as pa

from marketframe.llm import toxicity as T
from marketframe.llm.common import text_blocks

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in T.op3_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    toxic = [r for r in rows if labels[r["doc_id"]]]
    assert len(rows) > 500 and right / len(rows) > 0.97
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_composition_runs_the_machines_side_by_side():
    I, TG, N, R, O = T.INSULT, T.TARGET, T.NEGATION, T.REPORT, T.OTHER

    def slots(*symbols):
        out = [0.0] * T.SLOTS
        T.score_clause(list(symbols), [2.0 if s in (I, T.THREAT) else 0.0 for s in symbols], out)
        return out

    assert slots(O, I) == [2.0, 0, 0, 0, 0]
    assert slots(TG, O, I) == [0, 3.0, 0, 0, 0]
    assert slots(I, O, TG) == [0, 3.0, 0, 0, 0]
    assert slots(TG, N, O, I) == [0, 0, 2.0 * 1.5 * 0.4, 0, 0]
    assert slots(R, O, O, O, O, O, I)[T.REPORTED] == 2.0 * 0.6
    assert slots(T.THREAT, O) == [0, 0, 0, 0, 0] and slots(T.THREAT, TG)[T.THREATENED] == 2.0
    assert slots(N, O, O, O, I) == [2.0, 0, 0, 0, 0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "an idiot text", 5), (3, "fine words", 5), (3, "fine words", 5)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 1), (3, 0, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = T.scored(docs, labels).collect()
    assert len(rows) == 5 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
    kept = T.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5
    assert T.scored(docs.limit(0), labels).collect() == []


def test_lexicon_of_other_languages_is_learned(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"das ist ein satz nummer{i} und " + ("dummkopf" + "chenxyz"[:i % 7] if bad else "freund") + " hier", 0))
        labels.append((i, 0, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    out = {r["doc_id"]: r["predicted"] for r in T.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i] == (i % 4 == 0) for i in range(400))


def brute_slots(text, lexicon):
    """Slots of a whole text, word by word and without any automaton."""
    out = [0.0] * T.SLOTS
    for line in (text or "").split("\n"):
        clause = []
        for raw in re.findall(r"[^\x20\x09-\x0D]+", line) + [None]:
            if raw is not None:
                word = re.sub(r"^\W+|\W+$", "", raw).lower()
                fixed = [k for k, ws in ((T.TARGET, T.TARGETS), (T.NEGATION, T.NEGATIONS), (T.REPORT, T.REPORTS), (T.THREAT, T.THREATS)) if word in ws]
                found = [word[:k] for k in range(8, 3, -1) if len(word) >= k and word[:k] in lexicon] + [f"={word}"] * (f"={word}" in lexicon)
                clause.append((fixed[0], T.THREAT_WEIGHT) if fixed else lexicon[found[0]] if found else (T.OTHER, 0.0))
            if raw is None or raw[-1] in ".,;:!?|":
                kinds = [k for k, _ in clause]
                for i, (kind, weight) in enumerate(clause):
                    before, behind = kinds[:i], kinds[i + 1:]
                    aimed, later = T.TARGET in before[-T.REACH:], T.TARGET in behind[:T.REACH]
                    negated, reported = T.NEGATION in before[-3:], T.REPORT in before
                    damp = (T.DAMP_NEGATED if negated else 1) * (T.DAMP_REPORTED if reported else 1)
                    if kind == T.THREAT and (aimed or later):
                        out[T.THREATENED] += weight * (T.AIM if aimed else 1) * damp
                    if kind == T.INSULT:
                        plain = not negated and not reported
                        slot = T.REPORTED if reported else T.NEGATED if negated else T.AIMED if aimed or later else T.PLAIN
                        out[slot] += weight * (T.AIM if aimed or later and plain else 1) * damp
                clause = []
    return out


def test_whole_texts_against_a_scorer_without_automata():
    rng = random.Random(8)
    lexicon = {"idio": (T.INSULT, 2.5), "idiotic": (T.INSULT, 4.0), "=ass": (T.INSULT, 1.5), "erase": (T.THREAT, 3.0)}
    vocabulary = ["idiot", "Idiotic!", "ass", "assets", "erased", "you", "YOU,", "not", "no", "said", "(said)", "kill", "töten", "plain", "word.", "x|", "été"]
    texts = ["", None, "\n\n", "kill"] + ["".join(rng.choice(vocabulary) + rng.choice((" ", " ", "\n", "\t")) for _ in range(rng.randrange(120))) for _ in range(300)]
    texts.append(" ".join(rng.choices(vocabulary, k=40_000)))
    got = np.concatenate([T.Grammar(lexicon).block(b) for b in text_blocks(pa.array(texts, pa.string()))])
    assert np.allclose(got[:, :T.SLOTS], [brute_slots(t, lexicon) for t in texts])


def test_cascade_is_one_transducer_over_five_machines():
    """Its states are those that the five can be in at once (no word is both a
    target and a negation), and its marks are bounded."""
    assert len(T.AFTER) == ((T.REACH + 1) * (T.NEGATION_REACH + 1) - T.NEGATION_REACH) * 2
    assert {o for row in T.OUTPUT for o in row if o} == {
        (slot, f) for slot, fs in ((T.PLAIN, [1.0]), (T.AIMED, [1.5]), (T.NEGATED, [0.4, 1.5 * 0.4]),
                                   (T.REPORTED, [0.6, 1.5 * 0.6, 0.4 * 0.6, 1.5 * 0.4 * 0.6]),
                                   (T.THREATENED, [a * n * r for a in (1.0, 1.5) for n in (1.0, 0.4) for r in (1.0, 0.6)])) for f in fs}


def test_threats_are_learned_where_they_meet_a_target(spark):
    """A verb that clean texts hold as often is a threat near a person only."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        filler = " ".join(f"w{rng.randrange(400)}" for _ in range(12))
        rows.append((i, f"{filler}. I will vaporize " + ("you" if bad else "water") + f". {filler}. you and me {filler}"))
        labels.append((i, 0, int(bad)))
    train = T.training(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lexicon = T.learn_lexicon(train)
    assert lexicon["vapo"][0] == T.THREAT and all(kind != T.INSULT for kind, _ in lexicon.values())
