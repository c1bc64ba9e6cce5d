"""The prefix table against the sentencepiece library."""

import hashlib
import random

import duckdb
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from stackloom.llm import sentencepiece_bpe as S  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path = S.default_model()
    return sentencepiece.SentencePieceProcessor(model_file=path), S.Codec(S.pieces(path))


def same(both, text):
    sp, codec = both
    ids = sp.encode(text)
    assert codec.code(text) == (",".join(map(str, ids)), sp.decode(ids)), text


def test_random_texts(both):
    rnd = random.Random(1)
    alphabets = ["ab ", "aAeE \n\t\r;)", "  ▁a", "éèçüß ñ語梦ア😀́", "the ing tion 0123456789.,!$%&*#", "".join(map(chr, range(0, 300))), "‍﻿\x00<0x41><s></s><unk>"]
    for alphabet in alphabets:
        for _ in range(600):
            same(both, "".join(rnd.choices(alphabet, k=rnd.randint(0, 30))))
    for n in range(60):
        same(both, " " * n)
        same(both, "x" + " " * n + "y")
        same(both, "a" * n)


def test_driver_texts(both):
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    for (text,) in rows:
        same(both, text)


def test_query(spark, both):
    rows = [(1, "Hello  world\n"), (None, None), (2, ""), (2, ""), (3, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' ids", "1 n_tokens")
    want = []
    for d, t in rows:
        ids = both[0].encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(both[0].decode(ids).encode()).hexdigest()))
    got = S.encode_decode(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert S.encode_decode(df.limit(0)).count() == 0
