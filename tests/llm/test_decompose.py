"""Pieces of power-of-two lengths against the vocabulary's own tokenizer."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import queries
from tickloom.llm.decompose import binary_cuts, bucket_report, decompose_documents, write_buckets

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_cuts_are_the_bits_of_the_length():
    for n in [1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 100, 12345]:
        lengths = np.diff(binary_cuts(n, 8)).tolist()
        assert sum(lengths) == n and lengths[: n // 8] == [8] * (n // 8)
        assert lengths[n // 8 :] == [1 << b for b in (2, 1, 0) if n % 8 >> b & 1]


def check(rows, texts, tokenizer, length=2048):
    """Every id in one piece, every piece a full sequence of its own."""
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == 2**r.bucket <= length for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = ids_of(tokenizer, texts[i]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert len(pieces) <= len(ids) / length + math.log2(length)


def test_whole_table(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    check(queries.op12_binary_packing(spark, D).collect(), texts, tokenizer)


def test_nulls_empty_long_and_clashing_columns(spark, tokenizer):
    texts = {1: None, 2: "", 3: "word " * 50_000, 4: "  two   spaces\n\n <|endoftext|> x", 5: "é\U0001f600 café", None: "no id"}
    df = spark.createDataFrame([(i, t, 7, 1.5) for i, t in texts.items()], "doc_id long, text string, length long, ids double")
    rows = decompose_documents(df).collect()
    check(rows, texts, tokenizer)
    assert [(r.start, r.length) for r in rows if r.doc_id in (1, 2)] == [(0, 1), (0, 1)]


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the same words here")] * 5, "doc_id long, text string")
    rows = decompose_documents(df, length=4).collect()
    assert len(rows) % 5 == 0 and len({r.sequence_id for r in rows}) == len(rows)
    assert decompose_documents(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        decompose_documents(df, length=1000)


def test_buckets_on_disk_hold_the_texts(spark, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    for _ in range(2):
        write_buckets(docs, str(tmp_path / "buckets"))
    held = spark.read.parquet(str(tmp_path / "buckets"))
    found = {}
    for r in held.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == 2**r.bucket
        found.setdefault(r.doc_id, []).append((r.start, ids))
    for r in docs.collect():
        assert sum((ids for _, ids in sorted(found.pop(r.doc_id))), []) == ids_of(tokenizer, r.text)
    assert not found
    report = {r.bucket: (r.length, r.sequences, r.tokens) for r in bucket_report(held).collect()}
    assert all(t == n * s and n == 2**b for b, (n, s, t) in report.items())
