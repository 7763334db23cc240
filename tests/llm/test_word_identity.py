"""Words that a sum of powers cannot tell apart stay apart: identity goes by bytes,
and the hash of a run is not linear in its bytes."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketframe.llm import common, jaccard_join, token_counts, token_files


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096, 8192)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * k + j, t) for k, (x, y) in enumerate(PAIRS)
            for j, t in enumerate([f"{x} {y}", f"{y} {x} end", x, y])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_hashes_and_groups_differ():
    for x, y in PAIRS:
        raw = np.frombuffer((x + y + x).encode(), np.uint8)
        n = len(x)
        start, end = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
        h = common.span_hashes(raw, start, end)
        assert h[0] == h[2] != h[1]
        first, inverse = common.distinct_spans(raw, start, end)
        assert inverse.tolist() == [inverse[0], inverse[1], inverse[0]] and inverse[0] != inverse[1]


def test_groups_by_bytes_when_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(common, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    texts = [b"one", b"two", b"one", b"three-and-more", b"three-and-less", b"two", b"three-and-more"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    first, inverse = common.distinct_spans(raw, start, end)
    assert [texts[first[i]] for i in inverse] == texts and len(first) == 4


def test_token_ids_and_counts_equal_the_library(spark, docs, tmp):
    rows, df = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    manifest = token_files.write(df, f"{tmp}/ids", path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, manifest).collect()}
    assert got == {d: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in expected.items()}

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows}


def test_no_link_between_colliding_texts(spark):
    x, y = PAIRS[1]
    rows = [(1, f"{x} a b c d"), (2, f"{y} a b c d")]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 2)}
