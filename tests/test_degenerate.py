"""Errors that say what is wrong with which run or feature, sequences of vectors, and transitions between classes."""

import numpy as np
import pytest

from tickloom.operators import evaluate, monitor, normalize


def log(spark, losses):
    return spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, epoch int, val_loss double")


def test_errors_name_run_epoch_and_metric(spark):
    monitor.require_defined(log(spark, [1.0, 0.5]))
    with pytest.raises(monitor.MonitorUndefined) as e:
        monitor.require_defined(log(spark, [1.0, None, float("nan")]))
    assert (e.value.run, e.value.epoch, e.value.metric, e.value.value) == ("r", 1, "val_loss", None)
    with pytest.raises(monitor.TrainingDiverged, match="run r, epoch 1: the loss is not finite") as e:
        monitor.require_finite_losses(log(spark, [1.0, float("inf")]), "val_loss")
    assert e.value.value == float("inf")


def test_features_that_cannot_be_scaled(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, nan, 3.0, 4.0],), ([2.0, None, 3.0, 4.0],)], "features array<double>")
    with pytest.raises(normalize.DegenerateFeatures) as e:
        normalize.require_finite_columns(df)
    assert (e.value.indices, e.value.reason) == ([1], "no_finite_value")
    with pytest.raises(normalize.DegenerateFeatures) as e:
        normalize.require_finite_columns(df, excluded=(1, 3), eps=1e-8)
    assert (e.value.indices, e.value.reason, e.value.eps) == ([2], "no_variance", 1e-8)
    normalize.require_finite_columns(df, excluded=(1, 2, 3), eps=1e-8)


def test_sequences_are_scaled_step_by_step(spark):
    x = np.random.default_rng(0).normal(3, 2, (20, 4, 60))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, sequence array<array<double>>")
    layout = normalize.layout("grouped")
    stats = normalize.hybrid_stats(df, layout, (50,), "sequence")
    got = np.array(normalize.apply_hybrid(df, stats, "sequence").orderBy("i").toPandas()["sequence"].map(lambda s: np.stack(s)).tolist())
    want = x.copy()
    for idx in (layout[0], layout[1], *([k] for k in range(40, 60) if k != 50)):
        part = x[:, :, idx]
        want[:, :, idx] = (part - part.mean()) / part.std()
    np.testing.assert_allclose(got, np.where(np.arange(60) == 50, x, np.clip(want, -10, 10)), atol=1e-9)
    pooled = normalize.apply_global(df, normalize.pooled_stats(df, layout, "sequence"), layout, "sequence").orderBy("i").toPandas()["sequence"]
    np.testing.assert_allclose(np.stack(pooled[0])[:, 0], (x[0, :, 0] - x[:, :, layout[0]].mean()) / (x[:, :, layout[0]].std() + 1e-8), atol=1e-9)


def test_transitions(spark):
    df = spark.createDataFrame([("s", 0, k, c, p) for k, (c, p) in enumerate([(0, 0), (0, 1), (2, 2), (0, 0), (0, 0)])], "split string, day int, seq int, label int, pred int")
    got = {(r.before, r.label): (r.n, r.share, r.hit) for r in evaluate.transition_report(df).collect()}
    assert len(got) == 9 and got[0, 0] == (2, pytest.approx(2 / 3), 0.5) and got[0, 2] == (1, pytest.approx(1 / 3), 1.0) and got[2, 0] == (1, 1.0, 1.0) and got[1, 1] == (0, 0.0, 0.0)
