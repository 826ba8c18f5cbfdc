"""Rules on a stream that is stopped and resumed, against the batch rules over the whole log."""

import numpy as np
import pytest

from tickloom.operators import monitor
from tickloom.streaming.rules import LOG, LogRules, write_rules

KEYS = ["run", "epoch"]


def log(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for run in ("a", "b", "c"):
        val = 1.0
        for epoch in range(14):
            val += float(rng.normal(-0.02, 0.2))
            rows.append((run, epoch, float(1 / (epoch + 1)), None if (run, epoch) == ("b", 4) else val, float(rng.uniform(0.2, 0.6))))
    return rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, LOG)
    flags = monitor.early_stopping(df, patience=3)
    overfit = monitor.overfit_flags(df).select(*KEYS, "overfit")
    health = monitor.health_flags(df, loss="val_loss").select(*KEYS, "stagnant", "diverged", "weak")
    return flags.join(overfit, KEYS).join(health, KEYS)


def test_a_resumed_stream_equals_the_batch(spark, tmp_path):
    rows = log()
    spark.createDataFrame(rows[:0], LOG).write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out, checkpoint = str(tmp_path / "flags"), str(tmp_path / "checkpoint")
    for first, last in ((0, 5), (5, 6), (6, 14)):
        part = [r for r in rows if first <= r[1] < last] + [r for r in rows if r[1] == first - 1]  # the last epoch is sent again
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        write_rules(stream(), out, checkpoint).awaitTermination()  # a new query each time: its state comes from the checkpoint
    names = [*KEYS, "improved", "best", "waited", "stop", "overfit", "stagnant", "diverged", "weak"]
    got, want = (sorted(map(tuple, df.select(*names).collect())) for df in (spark.read.parquet(out), batch(spark, rows)))
    assert len(got) == len(rows)
    for g, w in zip(got, want):
        assert g[:4:2] + g[4:] == w[:4:2] + w[4:] and g[1] == w[1], (g, w)
        assert g[3] == pytest.approx(w[3])


def test_one_step_at_a_time():
    rules = LogRules(patience=2, min_delta=0.1)
    held = dict.fromkeys(["epoch", "best", "train1", "train2", "val1", "val2", "first", "top", "top_epoch"]) | {"waited": 0, "stop": False}
    got = [rules.step(held, {"run": "r", "epoch": k, "train_loss": 1.0, "val_loss": v, "accuracy": 0.1}) for k, v in enumerate([1.0, 0.95, float("nan"), 0.5, 3.0])]
    assert [g["improved"] for g in got] == [True, False, False, True, False]
    assert [g["waited"] for g in got] == [0, 1, 2, 0, 1] and [g["stop"] for g in got] == [False, False, True, True, True]
    assert [g["diverged"] for g in got] == [False, False, None, False, True] and got[4]["weak"] and not got[3]["weak"]
