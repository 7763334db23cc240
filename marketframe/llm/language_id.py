"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, labels every
byte position with language probabilities, and a document's probabilities are
the mean over all its positions (whole texts; states start anew per window).
Gates use the piecewise-linear sigmoid, candidates tanh. It is trained in numpy
by backpropagation through time (Adam) on a bounded sample: per language the
``PER_LANGUAGE`` documents with the smallest seeded hash, ``WINDOWS_PER_DOC``
windows of each. Training uses only text and lang of rows whose crc32(doc_id)
mod 3 is not 1; lang, source and doc_id are no inputs of a prediction.

Defined cases: a null text or one without a letter gives 'und' with score 0; a
null doc_id is not held out and takes no part in training, as do rows without
a lang; repeated rows are predicted alike; without training rows every text
with a letter is 'und' with score 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import Texts, table, text_blocks, tidy

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 300
WINDOWS_PER_DOC = 6
STEPS = 300
BATCH = 128
RATE = 0.02
SEED = 7
UNKNOWN = "und"


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


class Direction:
    """One direction of the recurrence; ``x`` has the shape (time, rows)."""

    NAMES = ("w", "u", "uc")  # byte tables of z, r, c; recurrent of z and r; recurrent of c

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.w = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.uc = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray):
        k = self.h
        a = self.w[x]
        zr = _gate(a[:, :2 * k] + h @ self.u)
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(a[:, 2 * k:] + (r * h) @ self.uc)
        return h + z * (c - h), zr, c

    def forward(self, x: np.ndarray):
        """States after every position, and what the backward pass needs."""
        h = np.zeros((x.shape[1], self.h), self.w.dtype)
        states, trace = [], []
        for t in range(len(x)):
            new, zr, c = self.step(x[t], h)
            trace.append((h, zr, c))
            states.append(new)
            h = new
        return np.stack(states), trace

    def backward(self, x: np.ndarray, trace, grad: np.ndarray) -> dict[str, np.ndarray]:
        k = self.h
        g = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        back = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, zr, c = trace[t]
            z, r = zr[:, :k], zr[:, k:]
            dh = grad[t] + back
            dc = dh * z * (1 - c * c)
            drh = dc @ self.uc.T
            dzr = np.concatenate([dh * (c - h), drh * h], axis=1) * np.where((zr > 0) & (zr < 1), np.float32(0.25), np.float32(0))
            g["u"] += h.T @ dzr
            g["uc"] += (r * h).T @ dc
            np.add.at(g["w"], x[t], np.concatenate([dzr, dc], axis=1))
            back = dh * (1 - z) + drh * r + dzr @ self.u.T
        return g


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.v = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[tuple[object, str]]:
        return [(d, n) for d in (self.ahead, self.behind) for n in Direction.NAMES] + [(self, "v"), (self, "b")]

    def loss_and_gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over valid positions; x, valid (time, rows); y (rows)."""
        f, trace_f = self.ahead.forward(x)
        rx = x[::-1]
        r, trace_r = self.behind.forward(rx)
        both = np.concatenate([f, r[::-1]], axis=2)
        p = softmax(both @ self.v + self.b)
        n = max(int(valid.sum()), 1)
        rows = np.arange(x.shape[1])
        loss = -float((np.log(p[:, rows, y] + 1e-12) * valid).sum()) / n
        d = p
        d[:, rows, y] -= 1
        d *= (valid / n)[:, :, None].astype(d.dtype)
        h = self.ahead.h
        gv = np.einsum("trh,trk->hk", both, d)
        back = d @ self.v.T
        gf = self.ahead.backward(x, trace_f, back[:, :, :h])
        gr = self.behind.backward(rx, trace_r, back[::-1, :, h:])
        return loss, [gf[n] for n in Direction.NAMES] + [gr[n] for n in Direction.NAMES] + [gv, d.sum((0, 1))]

    def train(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        places = self.parameters()
        m = [np.zeros_like(getattr(o, n)) for o, n in places]
        s = [np.zeros_like(getattr(o, n)) for o, n in places]
        for t in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            _, grads = self.loss_and_gradients(x[:, pick], valid[:, pick], y[pick])
            for i, ((o, n), g) in enumerate(zip(places, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                step = (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.99 ** t)) + 1e-6)
                setattr(o, n, (getattr(o, n) - RATE * (1 - t / (steps + 1)) * step).astype(np.float32))

    def window_sums(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sum of the language probabilities over the valid positions of every window."""
        t_len, rows = x.shape
        k = self.ahead.h
        seen = np.empty((t_len, rows, len(self.languages)), np.float32)
        h = np.zeros((rows, k), np.float32)
        for t in range(t_len):
            h = self.ahead.step(x[t], h)[0]
            seen[t] = h @ self.v[:k] + self.b
        h = np.zeros((rows, k), np.float32)
        out = np.zeros((rows, len(self.languages)), np.float32)
        for t in range(t_len - 1, -1, -1):
            h = self.behind.step(x[t], h)[0]
            h[~valid[t]] = 0  # bytes behind the end of a text leave no state
            e = np.exp(np.clip(seen[t] + h @ self.v[k:], -30, 30))
            e *= (valid[t] / e.sum(1))[:, None]
            out += e
        return out

    def block(self, block: Texts) -> np.ndarray:
        """Mean probabilities of every text of the block (zeros for empty texts)."""
        size = np.diff(block.offsets)
        count = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(block)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        out = np.zeros((len(block), len(self.languages)))
        for lo in range(0, len(owner), 8192):
            o = owner[lo:lo + 8192]
            x, valid = cut_windows(block.data, block.offsets[o] + nth[lo:lo + 8192] * WINDOW, block.offsets[o + 1])
            sums = self.window_sums(x, valid)
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(o, weights=sums[:, j], minlength=len(block))
        return out / np.maximum(size, 1)[:, None]


def cut_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, validity) of windows, shape (time, windows); bytes behind the end are 0."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    valid = at < end[None, :]
    x = np.where(valid, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return x, valid


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Bounded sample: at most per_language * WINDOWS_PER_DOC windows of a language."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(SEED)), "doc_id")
    some = known.select("lang", "doc_id", "text").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, parts = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8")
                last = max(len(raw) - WINDOW, 0)
                spots = sorted({last * i // max(WINDOWS_PER_DOC - 1, 1) for i in range(WINDOWS_PER_DOC)})
                langs += [lang] * len(spots)
                parts += [raw[s:s + WINDOW] for s in spots]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    rows = some.select("lang", "text").mapInArrow(tidy(cut), "lang string, part binary").collect()
    return sorted((r["lang"], bytes(r["part"])) for r in rows)


def train(docs: DataFrame) -> Network | None:
    rows = training_windows(docs)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    network = Network(languages)
    data = np.frombuffer(b"".join(p for _, p in rows), np.uint8)
    size = np.array([len(p) for _, p in rows])
    end = np.cumsum(size)
    x, valid = cut_windows(data, end - size, end)
    network.train(x, valid, np.array([languages.index(lang) for lang, _ in rows]))
    return network


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    network = train(docs)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column(1).to_numpy(zero_copy_only=False)
            names, scores = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if network is not None:
                for block in text_blocks(b.column(2), 1 << 20):
                    at = slice(block.first, block.first + len(block))
                    p = network.block(block)
                    names[at] = np.array(network.languages, object)[p.argmax(1)]
                    scores[at] = p.max(1)
                names[~ok], scores[~ok] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))],
                                             names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", letters.alias("ok"), "text").mapInArrow(tidy(predict), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents"))
