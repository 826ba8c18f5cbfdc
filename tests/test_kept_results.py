"""Artifacts, audits and checkpoints: what is read again, what is refused, and that nothing half-written counts."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import artifacts, audit, checkpoints, models
from tickloom.operators.validate import ContractError


def paired(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 9, n)
    return spark.createDataFrame([(i, float(v), float(v + rng.normal(0, 5)), float(rng.normal())) for i, v in enumerate(y)], "i long, y double, a double, b double")


def refuse():
    raise AssertionError("computed again")


def test_second_call_reads_and_changes_recompute(spark, tmp_path, monkeypatch, caplog):
    rows, path = paired(spark), str(tmp_path)
    call = lambda df=rows, **more: artifacts.ci_artifact(df, path, "y", "a", **({"replicates": 100} | more))
    first = call()
    want = sorted(map(tuple, first.table.collect()))
    assert not first.cached and first.drift == [] and len(want) == 7
    with monkeypatch.context() as m:
        m.setattr(artifacts, "bootstrap_ci", lambda *a: refuse())
        again = call(rows.repartition(5).orderBy("y"))
        assert again.cached and again.key == first.key and sorted(map(tuple, again.table.collect())) == want
        for change in ({"replicates": 101}, {"seed": 1}, {"confidence": 0.9}, {"length": 9}, {"metrics": ("mae",)}):
            with pytest.raises(AssertionError):
                call(**change)
        with pytest.raises(AssertionError):
            call(rows.withColumn("y", F.when(F.col("i") == 7, 0.0).otherwise(F.col("y"))))
    with caplog.at_level(logging.WARNING):
        other = call(seed=7, metrics=("mae", "ic"))
    assert not other.cached and len(other.drift) == 2 and "seed: 42 -> 7" in other.drift
    assert "metrics_ci is computed anew" in caplog.text
    changed = call(rows.where("i < 119"))
    assert "the rows changed" in changed.drift and not changed.cached
    assert call().cached and sorted(map(tuple, call().table.collect())) == want


def test_half_written_results_do_not_count(spark, tmp_path):
    rows = paired(spark)
    first = artifacts.pairwise_artifact(rows, str(tmp_path), "y", ["b", "a"], 100)
    assert artifacts.pairwise_artifact(rows, str(tmp_path), "y", ["a", "b"], 100).cached
    (tmp_path / "pairwise" / first.key / "_SUCCESS").unlink()
    again = artifacts.pairwise_artifact(rows, str(tmp_path), "y", ["a", "b"], 100)
    assert not again.cached and again.key == first.key and again.table.count() == 1
    assert artifacts.pairwise_artifact(rows, str(tmp_path), "y", ["a", "b"], 100, rerank=True).drift == ["rerank: False -> True"]


def test_fingerprints_see_rows_not_their_order(spark):
    df = spark.createDataFrame([(1, None), (None, 3), (2, 2)], "a int, b int")
    same = artifacts.rows_fingerprint(df.orderBy(F.desc("a")).repartition(3))
    assert artifacts.rows_fingerprint(df) == same
    others = [df.union(df.limit(1)), df.select("b", "a"), df.limit(0), df.select(F.col("b").alias("a"), F.col("a").alias("b")), df.select(F.col("a").cast("long").alias("a"), "b")]
    assert len({same, *map(artifacts.rows_fingerprint, others)}) == 6


def test_feature_statistics_are_kept(spark, tmp_path):
    df = spark.createDataFrame([([float(i), float(-i)],) for i in range(50)], "features array<double>")
    assert not artifacts.stats_artifact(df, str(tmp_path)).cached
    kept = artifacts.stats_artifact(df, str(tmp_path))
    assert kept.cached and {r.idx: r.median for r in kept.table.collect()} == {0: 24.5, 1: -24.5}


def export(spark):
    rows = [(s, f"2025010{d}", k, [float(k % 2), 1.0, float(k)], [k % 3 - 1]) for s, days in (("train", (1, 2)), ("val", (3,)), ("test", (4,))) for d in days for k in range(6)]
    return spark.createDataFrame(rows, "split string, day string, seq int, features array<double>, labels array<int>")


MANIFEST = {"feature_count": 3, "days_processed": 4, "total_rows": 24}
DOMAINS = {0: (0.0, 1.0), 2: None}


def broken(df):
    return {r.rule for r in df.collect() if not r.ok}


def test_audit_of_a_good_export(spark, tmp_path):
    got = audit.write_audited(export(spark).repartition(3), str(tmp_path / "x"), 3, DOMAINS, MANIFEST, require=True)
    assert broken(got) == set() and got.count() == 4 * 3 + 8
    assert spark.read.parquet(str(tmp_path / "x")).count() == 24


@pytest.mark.parametrize("change,manifest,rules", [
    (lambda df: df.where("split <> 'val'"), None, {"val rows", "val labels", "order of splits"}),
    (lambda df: df.withColumn("day", F.when(F.col("split") == "train", "20250109").otherwise(F.col("day"))), None, {"order of splits"}),
    (lambda df: df.withColumn("features", F.when((F.col("seq") == 3) & (F.col("split") == "test"), F.array(F.lit(0.0), F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("features"))), None, {"test values that are not finite"}),
    (lambda df: df.withColumn("labels", F.when(F.col("seq") == 0, F.array(F.lit(2))).otherwise(F.col("labels"))), None, {"train labels", "val labels", "test labels"}),
    (lambda df: df.withColumn("labels", F.when(F.col("day") == "20250102", F.lit(None)).otherwise(F.col("labels"))), None, {"train rows without labels"}),
    (lambda df: df.withColumn("features", F.slice("features", 1, 2)), None, {"rows without 3 features"}),
    (lambda df: df.withColumn("features", F.transform("features", lambda x: -x)), None, {"values of feature 0", "negative values in feature 2"}),
    (lambda df: df.union(df.limit(1).withColumn("split", F.lit("more"))), None, {"rows of other splits"}),
    (lambda df: df, {"feature_count": 98, "days_processed": 5, "total_rows": 23}, {"features of the manifest", "days of the manifest", "rows of the manifest"}),
])
def test_audit_finds_what_is_broken(spark, tmp_path, change, manifest, rules):
    got = audit.write_audited(change(export(spark)), str(tmp_path / "x"), 3, DOMAINS, manifest)
    assert broken(got) == rules
    if any(r.level == "error" and not r.ok for r in got.collect()):
        with pytest.raises(ContractError):
            audit.write_audited(change(export(spark)), str(tmp_path / "y"), 3, DOMAINS, manifest, require=True)


def test_manifest_is_optional(spark, tmp_path):
    assert audit.read_manifest(spark, str(tmp_path)) is None
    (tmp_path / "dataset_manifest.json").write_text('{"feature_count": 3,\n "days_processed": 4}')
    assert audit.read_manifest(spark, str(tmp_path)) == {"feature_count": 3, "days_processed": 4}


def classified(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.4).astype(int) + (x[:, 0] > 1.2)
    return spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "u double, v double, label int")


def test_checkpoint_gives_equal_scores_and_refuses_others(spark, tmp_path):
    rows, path = classified(spark), str(tmp_path / "model")
    scaler, model = models.fit_logistic(rows, ["u", "v"], "label", 3)
    contract = checkpoints.contract_of(rows, ["u", "v"], "label", "classification", "abc", 3, {"accuracy": 0.9})
    checkpoints.save_checkpoint([scaler, model], contract, path, spark)
    loaded, held = checkpoints.load_checkpoint(spark, path, "abc", ["u", "v"], "classification")
    assert held == contract
    got = checkpoints.score(rows, loaded, held).toPandas()
    direct = model.transform(scaler.transform(models.assemble(rows, ["u", "v"]))).toPandas()
    np.testing.assert_array_equal(np.array(got["probs"].tolist()), np.array([p.toArray() for p in direct["probability"]]))
    assert (got["pred"] == direct["prediction"]).all() and np.allclose([sum(p) for p in got["probs"]], 1)
    for wrong in ({"fingerprint": "other"}, {"features": ["v", "u"]}, {"task": "regression"}):
        with pytest.raises(checkpoints.CheckpointError, match=next(iter(wrong))):
            checkpoints.load_checkpoint(spark, path, **wrong)
    with pytest.raises(checkpoints.CheckpointError, match="v is missing"):
        checkpoints.score(rows.drop("v"), loaded, held)
    with pytest.raises(checkpoints.CheckpointError, match="u is float"):
        checkpoints.score(rows.withColumn("u", F.col("u").cast("float")), loaded, held)
    with pytest.raises(Exception, match="not finite"):
        checkpoints.score(rows.withColumn("u", F.lit(float("nan"))), loaded, held).collect()
    import json

    record = json.loads(checkpoints.classifier_metadata(checkpoints.score(rows, loaded, held), "label", "logistic", "e1").first().json)
    assert record["n"] == 300 and record["accuracy"] == pytest.approx((got["pred"] == got["label"]).mean(), abs=1e-6) and 0 <= record["ece"] <= 1


def test_incomplete_and_changed_checkpoints(spark, tmp_path):
    rows, path = classified(spark), tmp_path / "model"
    with pytest.raises(checkpoints.CheckpointError, match="no complete"):
        checkpoints.load_checkpoint(spark, str(path))
    contract = checkpoints.contract_of(rows, ["u"], "v", "regression", "abc")
    for _ in range(2):
        checkpoints.save_checkpoint([models.fit_ridge(rows, ["u"], "v")], contract, str(path), spark)
    assert checkpoints.score(rows, *checkpoints.load_checkpoint(spark, str(path))).columns == ["u", "v", "label", "yhat"]
    part = next((path / "contract").glob("part-*"))
    text = part.read_text()
    next((path / "contract").glob(".part-*.crc")).unlink()
    part.write_text(text.replace("abc", "abd"))
    with pytest.raises(checkpoints.CheckpointError, match="was changed"):
        checkpoints.load_checkpoint(spark, str(path))


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.95, 1, 1), (0.99, 1, 0), (0.5, 0, 0), (1.0, 2, 2)], "confidence double, pred int, label int")
    bins = {r.bin: (r.n, r.accuracy) for r in checkpoints.calibration(df, "label").collect()}
    assert bins == {9: (3, 2 / 3), 5: (1, 1.0)}
    assert checkpoints.expected_calibration_error(checkpoints.calibration(df, "label")).first().ece == pytest.approx((3 * abs(0.98 - 2 / 3) + 0.5) / 4)
