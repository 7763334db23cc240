"""Token files and token counts against the tokenizers library on whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketframe.llm import token_counts, token_files
from marketframe.llm.common import shared_dir, text_blocks

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t ", "plain words, and more.", "don't DON'T I'll he's it's 's", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
       "İstanbul ΣΑΣ ǅ ﬀ é é  nbsp em　x \u0085y", "tabs\t\tand  two   spaces \n\n lines\r\n", "9999 12a3 x_y ... !!! ,.,. a,b.c",
       "ß" * 300, "x" * 5000, "日本語 テキスト 한국어 😀😀", "trailing space ", " leading", "word" + " " * 50, "a\x1cb\x1fc", "Tion. tion, TION."]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, "s") for i, t in enumerate(texts)], "doc_id long, text string, start string")


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def expected_files(rows):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    out, at = [], 0
    for d, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_the_ids_of_whole_texts(spark):
    got = sorted(map(tuple, token_files.op1_token_files(spark, SF).collect()))
    assert got == expected_files(documents(spark))


def test_files_of_odd_texts(spark):
    manifest = token_files.write(frame(spark, ODD), shared_dir(spark, "t"), public_tokenizers.path(token_files.VOCABULARY), partitions=3)
    assert sorted(map(tuple, token_files.digest(spark, manifest).collect())) == expected_files(list(enumerate(ODD)))
    ends = np.cumsum([0] + [p["tokens"] for p in manifest["parts"]])
    assert [p["base"] for p in manifest["parts"]] == ends[:-1].tolist() and manifest["tokens"] == ends[-1]


def test_files_with_null_and_repeated_ids(spark):
    rows = [(None, "b"), (None, "a a"), (4, "x y z"), (4, "x y z"), (1, None)]
    df = frame(spark, [t for _, t in rows], [d for d, _ in rows])
    manifest = token_files.write(df, shared_dir(spark, "t"), public_tokenizers.path(token_files.VOCABULARY), partitions=2)
    got = token_files.digest(spark, manifest).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(False, 0), (False, 0), (True, 1), (True, 4), (True, 4)]
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [s for s, _, _ in starts] == np.cumsum([0] + [n for _, n, _ in starts])[:-1].tolist()
    assert [d for _, _, d in starts] == [None, None, 1, 4, 4]


def test_files_of_an_empty_table(spark):
    manifest = token_files.write(frame(spark, []), shared_dir(spark, "t"), public_tokenizers.path(token_files.VOCABULARY))
    assert token_files.digest(spark, manifest).collect() == []


@pytest.mark.parametrize("rows", ["documents", "odd"])
def test_counts_equal_the_library(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    if rows == "odd":
        data = list(enumerate(ODD))
        got = token_counts.token_counts(frame(spark, ODD), public_tokenizers.path(token_counts.VOCABULARY))
    else:
        data, got = documents(spark), token_counts.op6_token_counts(spark, SF)
    want = []
    for d, text in data:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((d, len((text or "").encode()), n, n > 512))
    assert sorted(map(tuple, got.collect())) == want


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(frame(spark, []), public_tokenizers.path(token_counts.VOCABULARY)).collect() == []


def test_merge_order_is_lowest_rank_leftmost_first():
    counter = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    for piece in ("aaaaaaa", "thethethe", "abababab", "zzzzzzzzzzzzz", "ationationa"):
        assert counter.merge_count(piece.encode()) == len(library.encode(piece).ids)


CUT = ["x≠y a.̸ ≮b", "don't''s x's 're5 '5s a''ll", "é.à5,ñ!! ×a÷b ß9 ÉÀ,É", "12a3.5,b", "é. e.́ 5́a", "a\x1f.b \x0b.,", "Σ.ς, ǅ5", "日本.語5", "<b|c |<"]


def test_pieces_hold_the_ids_of_whole_texts():
    coder = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    texts = CUT + ["".join(c) for c in zip(*[iter("".join(CUT) * 3)] * 7)]
    [block] = text_blocks(pa.array(texts))
    ids, counts = coder.block(block)
    ends = np.cumsum(counts)
    for text, piece in zip(texts, np.split(ids, ends[:-1])):
        assert piece.tolist() == coder.library.encode(text, add_special_tokens=False).ids, text


def test_new_words_of_a_block_are_encoded_together():
    class Counted:
        calls = 0

        def __init__(self, of):
            self.of = of

        def encode(self, *args, **named):
            Counted.calls += 1
            return self.of.encode(*args, **named)

    coder = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    library, coder.library = coder.library, Counted(coder.library)
    text = " ".join(f"œu{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))
    [block] = text_blocks(pa.array([text]))
    assert coder.block(block)[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert Counted.calls <= 2
