"""The stages one after another on the smallest tables, each held against brute force on its own input."""

import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from tickloom.llm import queries, simhash  # noqa: E402
from tickloom.llm.common import materialize, table  # noqa: E402
from tickloom.llm.packing import WordTokenizer  # noqa: E402
from tickloom.llm.quality import score_quality  # noqa: E402

D = "/root/testdata/sf0.001"


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_stages_follow_brute_force(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert [f.__name__ for f in steps.values()] == ["quality", "exact", "near", "mix", "pack"]
    docs = table(spark, D, "documents")
    columns = docs.columns

    good = materialize(steps["quality"](spark, docs, D), "t")
    scores = {r.doc_id: r.score for r in score_quality(docs, table(spark, D, "labels")).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {k for k, s in scores.items() if s >= 0.5}

    exact = materialize(steps["exact dedup"](spark, good, D), "t")
    best = {}
    for r in good.collect():
        key, rank = bare(r.text), (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(i for _, i in best.values())

    near = materialize(steps["near dedup"](spark, exact, D), "t")
    rows = exact.collect()
    fp = np.array([simhash.fingerprint(r.text.encode(), 5) for r in rows], np.uint64)
    words = [r.text.split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    group = {r.doc_id: {r.doc_id} for r in rows}
    for i, r in enumerate(rows):
        alike = [j for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        for j in [*np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3), *alike]:
            a, b = group[r.doc_id], group[rows[j].doc_id]
            if a is not b:
                a |= b
                for k in b:
                    group[k] = a
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted({min(g) for g in group.values()})

    mixed = materialize(steps["mixing"](spark, near, D), "t")
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in near.collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and times.keys() <= size.keys() and max(times.values()) <= 2
    total = sum(size.values())
    # A source misses its target by at most half of its longest document.
    assert abs(sum(times[k] * size[k] for k in times) - 1.5 * total) < 10 * max(size.values())

    packed = steps["packing"](spark, mixed, D).collect()
    tokenizer = WordTokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sum(len(tokenizer.whole([r.text])[0]) // 4 + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == want
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fill.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 1024
    assert len(fill) <= 1.03 * want / 1024 + 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, D), connect(D), queries.oracle_sql()[name])


def test_queries_cover_every_row(spark):
    for name, rows in (("op2_mixing", "documents"), ("op4_toxicity", "documents"), ("op5_quality", "documents"), ("op8_simhash", "documents")):
        got = queries.queries()[name](spark, D)
        assert got.select("doc_id").distinct().count() == got.count() == table(spark, D, rows).count(), name
    got = queries.queries()["op6_nearest"](spark, D)
    ids = [r.vec_id for r in table(spark, D, "embeddings").select("vec_id").collect()]
    assert got.groupBy("query_id").count().where("count = 20").count() == sum(i % 20 == 0 for i in ids)


def test_nulls_and_clashing_columns_pass_through(spark):
    rows = [(1, "a b c", "en", None), (2, None, None, "s"), (None, "a b c", "en", "s"), (3, "x " * 20_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_chars", "2 AS _row", "3 AS _id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, D)
        assert docs_out.columns == docs.columns and docs_out.count() <= 2 * len(rows), name
    assert corpus_pipeline.pack(spark, docs, D).agg(F.sum("length")).first()[0] > 20_000
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0, name
