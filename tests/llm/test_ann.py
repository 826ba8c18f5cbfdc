import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries
from tickloom.llm.ann import hilbert_keys, nearest, norm_ranges


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (5, 2), (8, 1), (1, 4)])
def test_hilbert_curve_takes_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def exact(ids, x, k, every):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def search(spark, x, **options):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = nearest(df, F.col("id") % 20 == 0, **options).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    return got


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16)) * rng.uniform(0.2, 3, (200, 1))
    x[50:120] = x[50]
    assert search(spark, x, k=20) == exact(np.arange(200), x, 20, 20)
    assert search(spark, x[:7], k=20) == exact(np.arange(7), x[:7], 20, 20)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_beyond_one_block(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.5, 1.5, (6000, 1))
    got, want = search(spark, x, least=32, most_block=50), exact(np.arange(6000), x, 20, 20)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_a_third_of_copies_hides_no_neighbour(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(6000)[:2000]] = x[0]
    got, want = search(spark, x, least=32, most_block=50), exact(np.arange(6000), x, 20, 20)
    same = [q for q in want if (x[q] == x[0]).all()]
    assert len(same) > 50 and all(got[q] == want[q] for q in same)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("width", [1e-3, 1e-6])
def test_a_third_in_a_tight_cluster(spark, width):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    some = rng.permutation(6000)[:2000]
    x[some] = x[0] + width * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = search(spark, x, least=32, most_block=50)
    recall = []
    for q in set(some.tolist()) & got.keys():
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        recall.append(len(set(got[q]) & set(np.argsort(far)[:20].tolist())) / 20)
    assert len(recall) > 50 and np.mean(recall) >= 0.9


def recall_of(got, want):
    assert got.keys() == want.keys()
    return np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])


def test_one_long_vector_leaves_the_others_order(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 8))
    x[17] *= 1000
    assert recall_of(search(spark, x, least=32, most_block=50, curves=8), exact(np.arange(6000), x, 20, 20)) >= 0.9


def test_recall_with_heavy_tailed_norms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x *= (rng.pareto(1, (6000, 1)) + 1) / np.linalg.norm(x, axis=1, keepdims=True)
    assert recall_of(search(spark, x, least=32, most_block=50), exact(np.arange(6000), x, 20, 20)) >= 0.9


def test_norm_ranges():
    assert norm_ranges({0: 1, 3: 5, 10: 900, 11: 800, 12: 3, 40: 2}, 100, 8) == [(3, 6), (10, 900), (11, 800), (40, 5)]
    assert norm_ranges({0: 500, 1: 500, 2: 500, 9: 500}, 100, 2) == [(0, 500), (9, 1500)]


def test_recall_of_the_query_on_a_whole_table(spark):
    """The query's own defaults, by curves like every size, on the given vectors."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op6_nearest(spark, d).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall_of(got, exact(ids, x, 20, 20)) >= 0.9


def test_recall_with_the_defaults_beyond_ten_thousand(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("id") % 100 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall_of(got, exact(np.arange(12_000), x, 20, 100)) >= 0.9


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [2.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (20, 1, 0, 4.0), (20, 2, 0, 2.0), (20, 3, 1, 2.0)]


def test_odd_vectors_take_no_part(spark):
    bad = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (40, [0.0, 0.0]), (60, [bad, 1.0]), (80, [float("inf"), 1.0]), (100, None), (120, [1.0, None]), (140, []), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS curve", "true AS query")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("id") % 20 == 0, k=20).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0)]
    assert nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
