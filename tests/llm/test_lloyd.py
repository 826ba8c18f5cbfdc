"""Delta rounds against plain full rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lloyd, queries

D = "/root/testdata/sf0.001"


def plain(rows, k, rounds, width=64, scale=1024, prefix="3:"):
    """{position in rows: (cluster, distance)}, and the final centroids: every round compares everything."""
    kept = {}
    for at, (i, v) in enumerate(rows):
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept[at] = [math.floor(float(x) * scale) for x in v]
    name = lambda at: (rows[at][0] is None, hashlib.sha256(f"{prefix}{rows[at][0]}".encode()).hexdigest(), kept[at])
    centroids = [kept[at] for at in sorted(kept, key=name)[:k]]

    def assign():
        return {at: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for at, v in kept.items()}

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [kept[at] for at, (_, o) in own.items() if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return {at: (j, d) for at, (d, j) in assign().items()}, centroids


def held(spark, rows, **options):
    width = options.get("width", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    got = lloyd.cluster_vectors(df, **options).collect()
    want, centroids = plain([(i, v) for i, v, _ in rows], options.get("k", 8), options.get("rounds", 10), width)
    total = sum(d for _, d in want.values())
    key = lambda x: tuple((v is None, v) for v in x)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = {j: sum(d for o, d in want.values() if o == j) for j in range(len(centroids))}
    expected = sorted(((rows[at][0], j, d, per[j], total, names[j]) for at, (j, d) in want.items()), key=key)
    assert sorted((tuple(r) for r in got), key=key) == expected
    return got


def vectors(n, seed, width=64, groups=5):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(groups)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.3))) for m in rng.choice(middles)], "x") for i in range(n)]


def test_clusters_are_those_of_full_rounds(spark):
    held(spark, vectors(400, 1))


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "CHUNK", 7)
    monkeypatch.setattr(lloyd, "PER_BUCKET", 2)
    held(spark, vectors(120, 2, width=4), width=4, k=5)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = vectors(60, 3, width=3, groups=2)
    rows += [(i, [0.5, 0.5, 0.5], "same") for i in range(100, 140)]
    rows += [(7, [0.25, 0.0, -0.25], "repeated id"), (7, [0.25, 0.0, -0.25], "repeated row"), (None, [0.1, 0.2, 0.3], "no id"), (None, [0.1, 0.2, 0.3], None)]
    rows += [(200, None, "x"), (201, [1.0, 2.0], "short"), (202, [1.0, None, 2.0], "x"), (203, [1.0, float("nan"), 2.0], "x"), (204, [float("inf"), 0.0, 0.0], "x"), (205, [], "x")]
    got = held(spark, rows, width=3)
    assert len(got) == 60 + 40 + 4


def test_equal_vectors_leave_centroids_empty(spark):
    held(spark, [(i, [0.5, -0.5], "x") for i in range(30)], width=2, k=4)


def test_fewer_vectors_than_centroids_and_none(spark):
    held(spark, vectors(3, 4, width=2), width=2, k=8)
    assert held(spark, [], width=2) == []


def test_components_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is"):
        lloyd.cluster_vectors(df, width=2).collect()


def test_reassign_equals_a_full_comparison():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, c = rng.integers(-4, 5, (30, 2)), rng.integers(-4, 5, (5, 2))
        first = lloyd.squared(x, c)
        owner, distance = first.argmin(1), first.min(1)
        changed = np.flatnonzero(rng.random(5) < 0.5)
        c[changed] = rng.integers(-4, 5, (len(changed), 2))
        every = lloyd.squared(x, c)
        got = lloyd.reassign(x, owner, distance, c, changed)
        assert (got[0] == every.argmin(1)).all() and (got[1] == every.min(1)).all()


def test_rounds_join_without_a_shuffle(spark):
    """Vectors and owners lie in the same buckets, so that a round's join has no exchange."""
    held_ = lloyd.store(spark.range(64).select(F.col("id").alias("chunk"), F.lit(b"1").alias("v")), 4, "vectors")
    owners = lloyd.store(spark.range(64).select(F.col("id").alias("chunk"), F.lit(b"1").alias("owner"), F.lit(b"1").alias("distance")), 4, "owners")
    plan = lloyd.next_assignments(spark.table(held_), spark.table(owners), np.zeros((2, 2), np.int64), np.arange(1))._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {held_}")
    spark.sql(f"DROP TABLE {owners}")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    want, _ = plain(rows, 8, 10)
    got = {r.vec_id: (r.cluster, r.distance) for r in queries.op11_centroids(spark, D).collect()}
    assert got == {rows[at][0]: x for at, x in want.items()}
