import hashlib
import random

import numpy as np
import pytest

from scanframe.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

ALPHABET = list("ab ' \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2009\u3000éß²½Ⅷ१٣中文字한글🙂👍🏽é_-.,!?'s't're've'll'd123×÷") + [
    "<|endoftext|>", "<|endoftext", "'ll", "  ", " \n", " " * 70, "abc" * 40, "x" * 200, "don't", "\u0301", "\x00", "\ufffd"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "<|endoftext|><|endoftext|>", "y" * 30_000, "z " * 9000]


def test_same_ids_as_the_library(library):
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    rows = texts(2000)
    for text, got, want in zip(rows, encoder.encode_all(rows), library.encode_batch(rows, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, text
        assert encoder.decode(got) == library.decode(want.ids, skip_special_tokens=False) == text


def test_results_do_not_depend_on_what_is_kept():
    v = bpe.load_vocabulary(bpe.vocabulary_path())
    rows = texts(300)
    small, large = bpe.Encoder(v, keep=5), bpe.Encoder(v)
    assert all((a == b).all() for a, b in zip(small.encode_all(rows), large.encode_all(rows), strict=True))


def test_both_ways_of_merging_agree():
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    rng = random.Random(2)
    for n in (2, 3, 17, 64):
        words = [bytes(rng.choice(b"aeiou thnsrl\xc3\xa9") for _ in range(n)) for _ in range(200)]
        for word, ids in zip(words, encoder._merged(words), strict=True):
            assert ids.tolist() == encoder._long(word).tolist()


def test_digests_columns_and_defined_cases(spark, library):
    rows = [(1, "Hello <|endoftext|> wörld"), (2, None), (2, ""), (None, "x"), (1, "Hello <|endoftext|> wörld")]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, ids string, n_tokens string")
    got = sorted(map(str, bpe.token_digests(df).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect())
    full = bpe.encode_documents(df)
    assert full.columns == ["doc_id", "text", "ids", "n_tokens", "ids_", "decoded"]
    assert all(r["ids"] == "own" and r["decoded"] == (r["text"] or "") and r["ids_"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in full.collect())
    assert bpe.encode_documents(df.limit(0)).count() == 0
