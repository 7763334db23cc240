"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon. Insults are learned from the training labels: a term is the first 4 to
8 letters of a word (or a whole shorter word). Terms that enough toxic
documents hold are counted over all labelled training documents; those with a
clear lift and a significant likelihood ratio become lexicon entries with their
log odds as weight; a word has the weight of its longest entry. Terms that are
no insults but pass the same tests where they stand within ``REACH`` words of a
person addressed become threats. Small fixed lists give targets, negations,
reported speech and the first threats in the four languages of the corpus.

Grammar. Every clause is the symbol sequence of its words. A transducer reads it
from the right and marks what stands before a target. From the left, five
transducers are a cascade, each reading what the one before wrote: TARGET marks
what follows a target, NEGATION what stands in the scope of a negation, REPORT
what is quoted, INSULT writes the weight factor of an insult in its marks, THREAT
that of a threatening verb that meets a target. The cascade is composed
once into one transducer over the reachable states; each match of a clause
adds its weight to the slot of its kind (plain, aimed, negated, reported, threat).

Score. A logistic model of the documents' slots, fitted on about ``FIT_ROWS``
labelled training rows (those of the smallest hashes; equal rows count once on
the way to the driver).

Training uses only labelled rows whose crc32(doc_id) mod 5 is not 0. Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have no match and get the score of an empty
slot vector; a null doc_id is not held out and has no label; several labels of
one id count as their maximum; repeated rows are scored alike; without labels
the lexicon is empty and the prior model holds; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import Cache, Texts, distinct_spans, stored, table, text_blocks, tidy, words

FIT_ROWS = 20_000
MIN_DOCS = 5          # toxic documents that a lexicon term needs at least,
MIN_SHARE = 0.002     # and its least share of the toxic training documents
LIFT = 1.0            # least log odds
SIGNIFICANCE = 24.0   # likelihood ratio (two degrees of one in a million)
REACH = 4

# Grammar words per language (en, de, fr, es).
TARGETS = """you your yours yourself he she they them him her his their
du dich dir dein deine ihr euch euer sie er
tu toi vous ton ta votre il elle ils elles
tú te ti tu usted ustedes él ella ellos""".split()
NEGATIONS = """not no never without isn't aren't wasn't don't
nicht kein keine nie ohne
ne pas jamais aucun sans
nunca jamás ni sin""".split()
REPORTS = """said says say called quoted reported claimed wrote
sagte sagt nannte zitierte
dit disait appelé cité
dijo dice llamó citó""".split()
THREATS = """kill hurt destroy murder beat shoot
töten umbringen schlagen
tuer frapper détruire
matar golpear destruir""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PLAIN, AIMED, NEGATED, REPORTED, THREATENED = range(5)
SLOTS = 5
THREAT_WEIGHT = 2.0


AIM, DAMP_NEGATED, DAMP_REPORTED = 1.5, 0.4, 0.6
NEGATION_REACH = 3


class Transducer:
    """Sequential transducer: ``step(state, symbol)`` gives the next state and
    the symbol written; ``start`` is the first state."""

    def __init__(self, step: Callable, start: int = 0):
        self.step, self.start = step, start


def marker(opener: int, reach: int, whole: bool = False) -> Transducer:
    """Writes each symbol with a mark: whether an opener was read within the last
    ``reach`` symbols (``whole``: at any time before)."""

    def step(state, symbol):
        after = reach if symbol[0] == opener else state if whole else max(state - 1, 0)
        return after, (*symbol, state > 0)

    return Transducer(step)


def _insult(state, symbol):
    """Reads (kind, ahead, behind, negated, reported); writes (slot, factor) for
    an insult. One aimed only by what follows it counts as aimed if it is
    neither negated nor reported."""
    kind, ahead, behind, negated, reported = symbol
    if kind != INSULT:
        return state, symbol
    slot = REPORTED if reported else NEGATED if negated else AIMED if ahead or behind else PLAIN
    aimed = behind or slot == AIMED
    return state, (slot, (AIM if aimed else 1.0) * (DAMP_NEGATED if negated else 1.0) * (DAMP_REPORTED if reported else 1.0))


def _threat(state, symbol):
    """Writes (slot, factor) for a threatening verb with a target before or
    behind it, passes on what INSULT wrote, and nothing for other words."""
    if len(symbol) == 2:
        return state, symbol
    kind, ahead, behind, negated, reported = symbol
    if kind != THREAT or not (ahead or behind):
        return state, None
    return state, (THREATENED, (AIM if behind else 1.0) * (DAMP_NEGATED if negated else 1.0) * (DAMP_REPORTED if reported else 1.0))


def compose(machines: list[Transducer], alphabet: list[tuple]) -> tuple[list[list[int]], list[list]]:
    """One transducer for a cascade: next state and output by state and symbol."""
    index = {tuple(m.start for m in machines): 0}
    queue, after, output = list(index), [], []
    for states in queue:
        to, out = [], []
        for symbol in alphabet:
            reached, written = [], symbol
            for m, state in zip(machines, states):
                state, written = m.step(state, written)
                reached.append(state)
            if tuple(reached) not in index:
                index[tuple(reached)] = len(index)
                queue.append(tuple(reached))
            to.append(index[tuple(reached)])
            out.append(written)
        after.append(to)
        output.append(out)
    return after, output


KINDS = [(kind,) for kind in range(6)]
MARKED = [(kind, ahead) for kind in range(6) for ahead in (False, True)]  # at 2 * kind + ahead
AHEAD, AHEAD_MARK = compose([marker(TARGET, REACH)], KINDS)
AFTER, OUTPUT = compose([marker(TARGET, REACH), marker(NEGATION, NEGATION_REACH), marker(REPORT, 1, whole=True),
                         Transducer(_insult), Transducer(_threat)], MARKED)


def score_clause(symbols: list[int], weights: list[float], slots: list[float]) -> None:
    """Run a clause from the right, then from the left; matches add to the slots."""
    state, marked = 0, []
    for symbol in reversed(symbols):
        marked.append(2 * symbol + AHEAD_MARK[state][symbol][1])
        state = AHEAD[state][symbol]
    state = 0
    for symbol, weight in zip(reversed(marked), weights):
        found = OUTPUT[state][symbol]
        if found:
            slots[found[0]] += weight * found[1]
        state = AFTER[state][symbol]


_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def terms(word: str) -> list[str]:
    return [word[:k] for k in range(min(8, len(word)), 3, -1)] or ([f"={word}"] if word else [])


def clean(raw: bytes) -> str:
    return _EDGE.sub("", raw.decode("utf-8")).lower()


_FIXED = {w: (s, wt) for s, ws, wt in ((TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0),
                                       (THREAT, THREATS, THREAT_WEIGHT)) for w in ws}


def clauses(block: Texts, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of each word's clause: stops, line breaks and texts end one."""
    stop = np.isin(block.data[end - 1], np.frombuffer(b".,;:!?|", np.uint8))
    gap = np.ones(len(start), bool)
    lines = np.cumsum(block.data == 10)
    gap[:-1] = (owner[1:] != owner[:-1]) | (lines[start[1:]] > lines[end[:-1] - 1])
    return np.concatenate([[0], np.cumsum(stop | gap)[:-1]])


class Grammar:
    """Classifies words and fills the slots of whole texts."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        self.lexicon = lexicon
        self.cache = Cache(50_000)

    def word(self, raw: bytes) -> tuple[int, float]:
        got = self.cache.get(raw)
        if got is None:
            word = clean(raw)
            got = _FIXED.get(word)
            if got is None:
                got = next((self.lexicon[t] for t in terms(word) if t in self.lexicon), (OTHER, 0.0))
            if len(raw) <= 64:
                self.cache.put(raw, got)
        return got

    def block(self, block: Texts) -> np.ndarray:
        """Slots and number of words of every text of the block."""
        out = np.zeros((len(block), SLOTS + 1))
        start, end, owner = words(block)
        if not len(start):
            return out
        out[:, SLOTS] = np.bincount(owner, minlength=len(block))
        view = block.data.tobytes()
        first, inverse = distinct_spans(block.data, start, end)
        known = [self.word(view[s:e]) for s, e in zip(start[first].tolist(), end[first].tolist())]
        symbol = np.array([k[0] for k in known], np.int8)[inverse]
        weight = np.array([k[1] for k in known])[inverse]
        clause = clauses(block, start, end, owner)
        for c in np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]).tolist():
            a, b = np.searchsorted(clause, [c, c + 1])
            score_clause(symbol[a:b].tolist(), weight[a:b].tolist(), out[owner[a]])
        return out


def features(slots: np.ndarray) -> np.ndarray:
    """Model inputs: log-scaled slots, and the plain and aimed mass per hundred words."""
    mass = np.log1p(np.maximum(slots[:, :SLOTS], 0))
    density = np.log1p(100 * slots[:, :2].sum(1) / np.maximum(slots[:, SLOTS], 1))
    return np.column_stack([np.ones(len(slots)), mass, density])


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps over rows that count ``times``, with a
    normal prior around weights that hold a document without matches clean and
    any plain match toxic."""
    prior = np.array([-3.0, 2.0, 2.0, 0.5, 0.5, 1.0, 0.5])
    strength = np.array([0.1] + [0.5] * (len(prior) - 1))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - y)) + strength * (w - prior)
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(strength), grad)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows outside the held-out part."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return docs.where("text is not null").join(known, "doc_id").select("doc_id", "text", "toxic")


_TARGETS = frozenset(TARGETS)
NEAR = "@"  # before terms: where they stand within REACH words of a target
HELD = 100_000  # terms that a task holds before it emits their counts


def _near_target(is_target: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """Whether another word within REACH words of the clause is a target."""
    near = np.zeros(len(clause), bool)
    for k in range(1, REACH + 1):
        same = clause[k:] == clause[:-k]
        near[k:] |= same & is_target[:-k]
        near[:-k] |= same & is_target[k:]
    return near


def _count_terms(candidates: set[str] | None):
    """Documents that hold each term, by label, and those that hold it near a
    target; candidates only if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tally = Cache(25_000), {}

        def of(raw: bytes) -> tuple:
            got = cache.get(raw)
            if got is None:
                word = clean(raw)
                got = tuple(t for t in terms(word) if candidates is None or t in candidates or NEAR + t in candidates)
                got = (word in _TARGETS, got)
                if len(raw) <= 64:
                    cache.put(raw, got)
            return got

        def emit() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array([v[1] for v in tally.values()], pa.int64()),
                                               pa.array([v[0] for v in tally.values()], pa.int64())], names=["term", "pos", "neg"])
            tally.clear()
            return rows

        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False) > 0
            for block in text_blocks(b.column(0)):
                start, end, owner = words(block)
                if not len(start):
                    continue
                view = block.data.tobytes()
                first, word = distinct_spans(block.data, start, end)
                known = [of(view[s:e]) for s, e in zip(start[first].tolist(), end[first].tolist())]
                near = _near_target(np.array([k[0] for k in known])[word], clauses(block, start, end, owner))
                names: dict[str, int] = {}
                flat = [names.setdefault(t, len(names)) for _, ts in known for t in ts]
                size = np.array([len(ts) for _, ts in known])
                held = np.unique((owner * len(first) + word) * 2 + near)  # word of a text, near or not
                text, of_word, close = held // 2 // len(first), held // 2 % len(first), held % 2
                n = size[of_word]
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (np.cumsum(size) - size)[of_word], n)
                term = np.array(flat, np.int64)[at]
                text, close = np.repeat(text, n), np.repeat(close, n)
                everywhere = np.unique(text * len(names) + term) if len(names) else term
                for mark, rows in (("", everywhere), (NEAR, np.unique((text * len(names) + term)[close == 1]) if len(names) else term)):
                    if not len(rows):
                        continue
                    t, y = rows % len(names), toxic[block.first + rows // len(names)].astype(np.int64)
                    per = np.bincount(2 * t + y, minlength=2 * len(names)).reshape(-1, 2)
                    for name, (no, yes) in zip(names, per.tolist()):
                        if (no or yes) and (candidates is None or mark + name in candidates):
                            v = tally.setdefault(mark + name, [0, 0])
                            v[0] += no
                            v[1] += yes
                if len(tally) > HELD:
                    yield emit()
        if tally:
            yield emit()

    return count


def learn_lexicon(rows: DataFrame) -> dict[str, tuple[int, float]]:
    """Lexicon terms with kind and weight. What reaches the driver is bounded by
    the share: a document holds a bounded number of terms on average, so at most
    that number / MIN_SHARE terms can be held by this share of documents."""
    schema = "term string, pos long, neg long"
    sizes = {r["y"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return {}
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * n_pos))
    bad = rows.where("toxic > 0").select("text", "toxic").mapInArrow(tidy(_count_terms(None)), schema)
    pos = {r["term"]: r["pos"] for r in bad.groupBy("term").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= least).collect()}
    good = rows.where("toxic <= 0").select("text", "toxic").mapInArrow(tidy(_count_terms(set(pos))), schema)
    neg = {r["term"]: r["neg"] for r in good.groupBy("term").agg(F.sum("neg").alias("neg")).collect()}
    lexicon: dict[str, tuple[int, float]] = {}
    for term, a in sorted(pos.items(), key=lambda x: x[0].startswith(NEAR)):  # insults first
        b = neg.get(term, 0)
        weight = math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n_neg + 1))
        if weight >= LIFT and _ratio(a, n_pos - a, b, n_neg - b) >= SIGNIFICANCE:
            name = term.removeprefix(NEAR)
            if name == term:
                lexicon[term] = (INSULT, min(6.0, weight))
            elif not any(name[:k] in lexicon for k in range(4, len(name) + 1)):
                lexicon[name] = (THREAT, min(6.0, weight))
    return lexicon


def _ratio(a: int, b: int, c: int, d: int) -> float:
    """Log-likelihood ratio of a two by two table."""
    n = a + b + c + d
    out = 0.0
    for x, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        if x:
            out += 2 * x * math.log(x * n / (r * k))
    return out


def _slots(grammar: Grammar, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, SLOTS + 1)), *[grammar.block(t) for t in text_blocks(column)]])


def _probability(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(slots) @ weights, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, tuple[int, float]], np.ndarray]:
    """(lexicon, model weights) from the training rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(training(docs, labels), "labelled")
    lexicon = learn_lexicon(rows)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            got = _slots(grammar, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(got), pa.list_(pa.float64()))], names=["toxic", "slots"])

    # rows of the smallest hashes, about FIT_ROWS; rows that repeat are one slot vector with a count
    share = min(1.0, FIT_ROWS / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    some = (sample.select("toxic", "text").mapInArrow(tidy(slots), "toxic int, slots array<double>")
            .groupBy("toxic", "slots").agg(F.count("*").alias("times")).collect())
    some = sorted(some, key=lambda r: (r["toxic"], r["slots"]))
    x = features(np.array([r["slots"] for r in some]).reshape(-1, SLOTS + 1))
    return lexicon, fit(x, np.array([r["toxic"] > 0 for r in some], float), np.array([r["times"] for r in some], float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, plain, aimed, ...) of every document."""
    lexicon, weights = learn(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            got = _slots(grammar, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_probability(got, weights)), *[pa.array(got[:, k]) for k in range(SLOTS)]],
                names=["doc_id", "score", "plain", "aimed", "negated", "reported", "threat"])

    schema = "doc_id long, score double, plain double, aimed double, negated double, reported double, threat double"
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(score), schema)
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    "plain", "aimed", "negated", "reported", "threat"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    lexicon, weights = learn(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            yield b.filter(pa.array(_probability(_slots(grammar, b.column(at)), weights) < 0.5))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")
