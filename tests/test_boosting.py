"""Boosted trees against a plain fit of the same definition in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting
from tickloom.operators.boosting import HuberTrees, fit_huber_trees, score_trees


def rank(x, p):
    return np.sort(x)[max(0, int(np.ceil(p * len(x))) - 1)]


def plain(x, y, trees, depth, step, leaf, alpha, bins):
    """Every row is drawn for every tree."""
    cuts = [sorted({rank(c, k / bins) for k in range(1, bins)}) for c in x.T]
    b = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    f = np.full(len(y), rank(y, 0.5))
    for _ in range(trees):
        r = y - f
        bound = rank(np.abs(r), alpha)
        g, node = np.clip(r, -bound, bound), np.ones(len(y), int)
        for level in range(depth):
            for k in [k for k in np.unique(node) if k >= 1 << level]:
                own, best = node == k, None
                for j in range(x.shape[1]):
                    for cut in np.unique(b[own, j])[:-1]:
                        left, right = own & (b[:, j] <= cut), own & (b[:, j] > cut)
                        if min(left.sum(), right.sum()) < leaf:
                            continue
                        gain = sum(g[s].sum() ** 2 / s.sum() for s in (left, right)) - g[own].sum() ** 2 / own.sum()
                        if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, j, cut)
                if best is not None:
                    node[own] = 2 * k + (b[own, best[1]] > best[2])
        for k in np.unique(node):
            own = node == k
            m = rank(r[own], 0.5)
            f[own] += step * (m + np.mean(np.sign(r[own] - m) * np.minimum(np.abs(r[own] - m), bound)))
    return f


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 5, n), rng.uniform(-2, 2, n)]
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=n)
    y[:20] += 500  # outliers, which the bound keeps small
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(3)


def test_fit_equals_the_plain_one(spark):
    x, y = data()
    model = fit_huber_trees(frame(spark, x, y), ["a", "b", "c"], "y", trees=7, depth=3, step=0.3, share=1.0, leaf=20, bins=16, every=3)
    np.testing.assert_allclose(model.predict(x), plain(x, y, 7, 3, 0.3, 20, 0.9, 16), rtol=1e-9)
    assert np.median(np.abs(model.predict(x) - y)[20:]) < 0.5
    scored = score_trees(frame(spark, x, y), model).toPandas()
    np.testing.assert_allclose(scored["yhat"], model.predict(scored[["a", "b", "c"]].to_numpy()))
    again = HuberTrees.from_json(model.to_json())
    np.testing.assert_array_equal(again.predict(x), model.predict(x))


def test_drawn_rows_and_reruns(spark):
    x, y = data(300, 1)
    df = frame(spark, x, y)
    a, b = (fit_huber_trees(df, ["a", "b", "c"], "y", trees=2, depth=2, leaf=10, share=0.5, seed=s) for s in (1, 2))
    assert a.to_json() != b.to_json()


def test_odd_rows(spark):
    rows = [(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (3.0, None), (2.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = fit_huber_trees(df, ["a"], "y", trees=2, share=1.0, leaf=1, step=1.0)
    assert [r.yhat for r in score_trees(df, model).collect()] == [2.0, None, None, 4.0, 4.0]
    constant = fit_huber_trees(df.withColumn("a", F.lit(1.0)), ["a"], "y", trees=1, share=1.0, leaf=1)
    assert constant.trees[0].splits == {}
    with pytest.raises(ValueError):
        fit_huber_trees(df.limit(0), ["a"], "y", trees=1)


def test_one_aggregate_per_level(spark):
    counts = [r for r in spark.createDataFrame([(1, 0, 0, 5, 5.0), (1, 0, 1, 5, -5.0), (1, 1, 0, 10, 0.0)], "node int, feature int, bin int, n long, s double").collect()]
    assert boosting.best_splits(counts, 2, 5) == {1: (0, 0)} and boosting.best_splits(counts, 2, 6) == {}
