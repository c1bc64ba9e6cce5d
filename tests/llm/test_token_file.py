"""Simple-8b words, files of tokens, and the encoder against the library."""

import zlib

import numpy as np
import pytest

from stackloom.llm.token_file import BLOCK, PACKED, Encoder, default_model, encode, op12_tokens, pack, read_tokens, register, unpack, write_tokens

TEXTS = ["", None, "a b", "it's 'START 'll ''s", "x\n\n y\t\tz  ", "größer ÀÖØ ßÿ×÷", "a<|endoftext|>b <|startoftext|>", "é ́x ΑΣ Σ ﬁ ١٢", "12345 #!?", "日本語 text", "\x00\x1c\x85 　", "word " * 30_000, "y" * 20_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_model())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7])
def test_packing_is_an_exact_round_trip(n):
    r = np.random.default_rng(n)
    for top in (0, 1, 7, 15, 16, 31, 59, 60, 63):
        width = r.integers(0, top + 1, n)
        ids = r.integers(0, 1 << 63, n, dtype=np.uint64) >> (63 - width).astype(np.uint64)
        words, first, escaped = pack(ids)
        assert (unpack(words, first, escaped, n) == ids).all()
        assert len(escaped) == (ids >= 1 << 60).sum() and len(first) == -(-n // BLOCK)


def test_words_hold_as_many_ids_as_their_selector_says():
    for selector, (n, bits) in enumerate(PACKED, 1):
        words, _, _ = pack(np.full(n, (1 << bits) - 1, np.uint64))
        assert len(words) == 1 and int(words[0]) >> 60 == selector


def test_encoder_equals_the_library(library):
    with open(default_model(), encoding="utf-8") as f:
        e = Encoder(f.read())
    assert e.parted
    for t in [t or "" for t in TEXTS] * 2:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_another_tokenizer_is_given_whole_texts():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = Encoder(f.read())
    assert not e.parted
    assert np.frombuffer(e.encode("a b  c\n"), "<u4").tolist() == e.tokenizer.encode("a b  c\n", add_special_tokens=False).ids


def plain(library, rows):
    out, before = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(library, text)
        out.append((doc, before, ids))
        before += len(ids)
    return out


def test_files_give_back_every_document_in_order(spark, library, tmp_path):
    rows = [(50 - 3 * i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, at int, ids string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tokens(df, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r["doc_id"], r["start"], r["ids"]) for r in read_tokens(spark, f"{tmp_path}/t").collect())
    assert got == plain(library, rows)
    assert not list(tmp_path.glob("t/_temporary*")) and len(list(tmp_path.glob("t/*.s8b"))) >= 2


def test_ids_shared_by_many_rows_and_null_ids(spark, library, tmp_path):
    rows = [(7, "same text")] * 40 + [(None, "a"), (None, "b"), (9, "c")]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_path}/t")
    got = read_tokens(spark, f"{tmp_path}/t").collect()
    assert sorted(r["start"] for r in got) == [x[1] for x in plain(library, rows)]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None] * 2 + [7] * 40 + [9]


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/t")
    assert read_tokens(spark, f"{tmp_path}/t").collect() == []


def test_wide_ids_are_written_as_escapes(spark, tmp_path):
    register(spark)
    ids = [0, 5, (1 << 62) + 3, 1 << 60, 77] * 700
    spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<long>").coalesce(1).write.format("tokens8b").mode("append").save(f"{tmp_path}/t")
    assert [(r["doc_id"], r["start"], r["ids"]) for r in read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()] == [(1, 0, ids), (2, len(ids), []), (3, len(ids), [])]


def test_encode_keeps_rows(spark, library):
    df = spark.createDataFrame([(1, None), (1, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encode(df).collect()) == [(1, [1]), (1, ids_of(library, "a b"))]


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(doc, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for doc, before, ids in plain(library, rows)]
    assert sorted(map(tuple, op12_tokens(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
