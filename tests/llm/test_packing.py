import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import packing
from tickloom.llm.packing import WordTokenizer, assign_sequences, pack_documents, pack_lengths, sequence_ids, sequences

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER = WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé ß\n\t\r\x0b\xa0 '’s.,!?0٣9²|<>endoftxt漢😀\x00\x1c"), max_size=60))
def test_words_give_the_tokens_of_the_whole_text(text):
    assert TOKENIZER.encode(text) == TOKENIZER.whole([text])[0]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", " lead", "tail ", "tail \n", "a  b", "a\n\n b", "it's we'll they've", "x\n \ny", "\n a"])
def test_hard_texts(text):
    assert TOKENIZER.encode(text) == TOKENIZER.whole([text])[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_pack_lengths_is_a_packing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, full = pack_lengths(sizes, 64)
    by = {}
    for size, b, o, f in zip(sizes, bins.tolist(), offsets.tolist(), full.tolist()):
        by.setdefault(b, []).append((o, size, f))
    for items in by.values():
        items.sort()
        end = 0
        for o, size, _ in items:
            assert o == end
            end += size
        assert end <= 64 and all(f == (end == 64) for *_, f in items)


def test_packing_wastes_little():
    rng = np.random.default_rng(0)
    sizes = sorted(np.minimum(rng.lognormal(5.5, 1, 5000).astype(int) + 1, 1023).tolist(), reverse=True)
    bins, _, _ = pack_lengths(sizes, 1024)
    assert len(set(bins.tolist())) <= 1.01 * sum(sizes) / 1024 + 1


@pytest.mark.parametrize("shard", [1 << 16, 20])
def test_pieces_round_trip(spark, shard):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta.", "gamma", "|", "ÉÈ"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 400))))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "null id"), (102, "word " * 1023), (103, "long " * 5000), (104, "same"), (104, "same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bin")
    packed = pack_documents(df, length=128, shard=shard)
    rows = packed.collect()
    want = {}
    for i, text in docs:
        ids = np.frombuffer(TOKENIZER.whole([text or ""])[0], "<u4").tolist() + [2]
        want[i] = ids
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in by_doc.items():
        ids, at = want[i], 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and (k == 0 or length == 128)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for spans in by_seq.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 128
    assert sum(r.length for r in rows) == sum(len(x) for x in want.values()) + 2
    got = {r.sequence_id: r["ids"] for r in sequences(df, packed, length=128).collect()}
    assert {k: len(v) for k, v in got.items()} == {k: sum(n for _, n in v) for k, v in by_seq.items()}


def test_every_document_has_the_tokens_of_the_whole_text(spark, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    want = [x for i in range(0, len(texts), 500) for x in TOKENIZER.whole(texts[i : i + 500])]
    assert [TOKENIZER.encode(t) for t in texts] == want
    monkeypatch.setattr(packing, "SLICE", 100)
    assert [TOKENIZER.encode(t) for t in texts[:2000]] == want[:2000]


def test_sequence_ids_do_not_meet():
    bins = np.array([0, 1, (1 << 26) - 1])
    tasks, levels = [0, 1, 65_535, 65_536, 65_537, (1 << 31) - 1], [0, 1, 2, 63]
    got = [int(x) for t in tasks for level in levels for x in sequence_ids(bins, t, level)]
    assert len(set(got)) == len(got) and min(got) == 0 and max(got) < 1 << 63
    with pytest.raises(ValueError):
        sequence_ids(np.array([1 << 26]), 0, 0)


def test_rounds_keep_tasks_bounded(spark):
    # Most pieces fit no other: rounds end when nothing is saved, and no task gets them all.
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n)) for i, n in enumerate(np.r_[rng.integers(600, 1000, 3000), rng.integers(1, 400, 1500)])]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length long")
    out = assign_sequences(pieces, 1024, shard=300).collect()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fill.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 1024
    whole = assign_sequences(pieces, 1024).select("sequence_id").distinct().count()
    assert len(out) == len(rows) and len(fill) <= 1.01 * whole


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
