"""Selected quantiles against numpy's, over any number of rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quantiles
from tickloom.operators.quantiles import exact_quantiles, with_quantiles

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]


def plain(x):
    x = np.sort(x)
    out = []
    for p in LEVELS:
        at = p * (len(x) - 1)
        low, high = x[math.floor(at)], x[math.ceil(at)]
        out.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def columns(n=3000):
    rng = np.random.default_rng(3)
    third = rng.normal(size=n)
    third[: n // 3] = 0.125
    huge = np.exp(rng.uniform(-300, 300, n)) * rng.choice([-1, 1], n)
    return {"normal": rng.normal(size=n), "tied third": third, "few values": rng.integers(0, 4, n).astype(float), "huge": huge, "one outlier": np.r_[rng.normal(size=n - 1), 1e300], "constant": np.full(n, 7.5), "tiny": 1 + 1e-12 * rng.normal(size=n)}


@pytest.mark.parametrize("few,cells", [(100_000, 1 << 22), (20, 1 << 22), (20, 56)])
def test_quantiles_of_groups(spark, monkeypatch, few, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    held = columns()
    rows = [(name, float(x)) for name, values in held.items() for x in values]
    rows += [("normal", None), ("normal", float("nan")), ("normal", float("inf")), ("nothing", None), (None, 2.0), (None, 1.0), ("single", 5.0)]
    df = spark.createDataFrame(rows, "name string, x double").repartition(8)
    got = {r.name: (r.n, r.quantiles) for r in exact_quantiles(df, "x", LEVELS, ["name"], few=few).collect()}
    assert got.keys() == {*held, None, "single"}
    for name, values in held.items():
        assert got[name][0] == len(values)
        np.testing.assert_allclose(got[name][1], plain(values), rtol=1e-12, atol=0, err_msg=name)
    assert got[None] == (2, plain([1.0, 2.0])) and got["single"] == (1, [5.0] * len(LEVELS))


def test_whole_table_and_no_rows(spark):
    x = columns()["huge"]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    one = exact_quantiles(df, "x", LEVELS, [], few=10).collect()
    assert len(one) == 1
    np.testing.assert_allclose(one[0].quantiles, plain(x), rtol=1e-12)
    assert exact_quantiles(df.limit(0), "x", LEVELS, []).collect() == []
    nothing = with_quantiles(df.limit(0).agg(F.count("x").alias("n")), exact_quantiles(df.limit(0), "x", [0.5], []), [], ["median"]).collect()
    assert [tuple(r) for r in nothing] == [(0, None)]


def test_groups_by_several_keys_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(x)) for a, b, x in zip(rng.integers(0, 5, 4000), rng.integers(0, 6, 4000), rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "a int, b int, x double")
    for r in exact_quantiles(df, "x", LEVELS, ["a", "b"], few=5).collect():
        np.testing.assert_allclose(r.quantiles, plain([x for a, b, x in rows if (a, b) == (r.a, r.b)]), rtol=1e-12)


def test_no_aggregate_holds_a_column(spark):
    """No percentile over rows is left in the operators; those of replicates are over a fixed number of rows."""
    from pathlib import Path

    root = Path(quantiles.__file__).parent
    left = {f.name for f in root.glob("*.py") if "F.percentile(" in f.read_text()}
    assert left == {"resample.py"}
