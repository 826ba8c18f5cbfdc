import re

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.common import word_count
from tickloom.llm.mixing import mix_documents, mix_report, source_targets

WORDS = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        t = {s: 2 * sizes[s] if s in capped else left * w / free for s, w in weight.items()}
        over = {s for s in t if s not in capped and t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\n\x0bc ", "x y \x1c z", "\t\r\n", "😀 😀"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(WORDS.findall(t)) for t in texts]


def test_targets_share_the_excess(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        sizes = {None if k == n - 1 and n > 2 else f"s{k:02}": int(rng.integers(1, 10_000)) for k in range(n)}
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def test_mix_hits_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(4)
    docs = [(i, f"s{i % 7}" if i % 3 else "hot", "w " * int(rng.integers(0, 60))) for i in range(3000)] + [(5000, None, None), (5001, None, "a b"), (None, "s1", "x y z"), (7, "s0", "again"), (7, "s0", "again"), (6000, "empty", " ")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS rows")
    first = mix_report(df, bucket=8).collect()
    again = mix_report(df.repartition(3, "text"), bucket=8).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(docs)
    sizes, taken, target = {}, {}, {}
    source = {}
    for i, s, t in docs:
        source[i] = s
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    for r in first:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and (r.taken in (0, r["size"], 2 * r["size"]))
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 30, s
    mixed = mix_documents(df, bucket=8)
    assert mixed.columns == df.columns
    per_doc = {}
    for r in mixed.collect():
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + len(WORDS.findall(r.text))
    want_doc = {}
    for r in first:
        want_doc[r.doc_id] = want_doc.get(r.doc_id, 0) + r.taken
    assert per_doc == {k: v for k, v in want_doc.items() if v}


def test_expectation_is_kept(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("w w w").alias("text"))
    taken = {}
    for seed in range(12):
        for r in mix_report(docs, seed=seed, bucket=16).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken / 3
    # Twelve draws of 1.5 copies each.
    assert abs(np.mean(list(taken.values())) - 18) < 0.1 and 0.5 < np.std(list(taken.values())) < 3


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_report(empty).collect() == [] and mix_documents(empty).collect() == []
