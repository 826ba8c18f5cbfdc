import json

import pytest
from pyspark.sql import functions as F

from tickloom.plans import cli, config
from tickloom.sources import ticks
from tickloom.streaming.moments import batch_moments, finish_moments, merge_moments, stream_moments

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind,column", [("previous_label", "accuracy"), ("class_prior", "accuracy"), ("logistic", "accuracy"), ("ridge", "r2"), ("boosting", "r2")])
def test_train(spark, tmp_path, kind, column):
    (tmp_path / "c.yaml").write_text("name: n\nhypothesis: h\n")
    got = cli.main(["train", str(tmp_path / "c.yaml"), "--data", D, "--set", f"model.kind={kind}", "--set", "model.trees=3"], spark)
    rows = got.collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and all(r[column] is not None for r in rows)


def test_export_writes_what_the_model_says(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("name: n\nhypothesis: h\n")
    own, path = ["--data", D, "--set"], str(tmp_path / "signals")
    meta = json.loads(cli.main(["export", str(tmp_path / "c.yaml"), "--out", path, *own, "model.kind=ridge"], spark).first().json)
    got = spark.read.parquet(path)
    assert got.count() == meta["n"] > 0 and meta["experiment_id"] == "n" and {r.split for r in got.select("split").distinct().collect()} == {"train", "val", "test"}
    mse = {r.split: r.m for r in got.groupBy("split").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("m")).collect()}
    rmse = {r.split: r.rmse for r in cli.main(["train", str(tmp_path / "c.yaml"), *own, "model.kind=ridge"], spark).collect()}
    assert mse == pytest.approx({k: v * v for k, v in rmse.items()}, rel=1e-4)
    with pytest.raises(config.ConfigError):
        cli.main(["export", str(tmp_path / "c.yaml"), "--out", path, *own, "model.kind=logistic"], spark)


def test_run_writes_and_validates(spark, tmp_path):
    cli.main(["run", "q_class_prior", "--data", D, "--out", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    assert cli.main(["validate", "--data", D], spark).count() == 0
    assert cli.overrides(["a.b=3", "c=x", "d=[1]"]) == {"a.b": 3, "c": "x", "d": (1,)}
    with pytest.raises(config.ConfigError):
        cli.overrides(["a"])


def test_streamed_moments_equal_those_of_the_batch(spark, tmp_path):
    rows = ticks.ticks(spark, D).select("event_type", "value")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_moments(stream, ["event_type"], "value", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = finish_moments(merge_moments(spark.read.parquet(str(tmp_path / "out")), ["event_type"]))
    want = finish_moments(batch_moments(rows, ["event_type"], "value"))
    both = got.alias("a").join(want.alias("b"), "event_type")
    assert both.count() == want.count()
    assert both.where((F.col("a.n") != F.col("b.n")) | (F.abs(F.col("a.mean") - F.col("b.mean")) > 1e-9) | (F.abs(F.col("a.std") - F.col("b.std")) > 1e-9)).count() == 0


def test_signals_are_written_by_split_and_day(spark, tmp_path):
    path = str(tmp_path / "signals")
    rows = ticks.with_split(ticks.ticks(spark, D)).select("split", "day", "seq", "price")
    ticks.write_signals(rows, path)
    ticks.write_signals(rows.where("split = 'val'"), path)
    assert spark.read.parquet(path).count() == rows.count()
    one = ticks.read_split(spark, path, "val")
    assert one.count() == rows.where("split = 'val'").count()
    assert ticks.export_format(["sequence"]) == "aligned" and ticks.export_format(["features"]) == "legacy"
    with pytest.raises(ValueError):
        ticks.export_format(["x"])


def test_metadata_sidecars(spark, tmp_path):
    (tmp_path / "d1.json").write_text('{"day": "2024-01-01", "n_sequences": 5, "schema_version": "1", "labeling": {"horizons": [10, 60]}}')
    (tmp_path / "d2.json").write_text('{"day": "2024-01-02", "n_sequences": 7, "schema_version": "1", "horizons": [10, 60]}')
    got = ticks.metadata(spark, str(tmp_path / "*.json")).orderBy("day").collect()
    assert [(r.day, r.n_sequences, r.horizons) for r in got] == [("2024-01-01", 5, [10, 60]), ("2024-01-02", 7, [10, 60])]


def test_kept_results_from_the_command_line(spark, tmp_path, capsys):
    rows = spark.range(200).selectExpr("'test' AS split", "concat('2025-01-0', id % 2 + 1) AS day", "id AS seq", "CAST((id * 37) % 101 AS double) AS y")
    for name, factor in (("a", 0.5), ("b", -0.2)):
        ticks.write_signals(rows.selectExpr("*", f"y * {factor} + seq % 7 AS yhat"), str(tmp_path / name))
    ci = ["ci", "--signals", str(tmp_path / "a"), "--out", str(tmp_path / "kept"), "--replicates", "100"]
    first = cli.main(ci, spark).count()
    assert first == 7 and "computed" in capsys.readouterr().out
    assert cli.main(ci, spark).count() == 7 and capsys.readouterr().out.startswith("read")
    cli.main([*ci, "--seed", "3"], spark)
    assert "seed: 42 -> 3" in capsys.readouterr().out
    pair = ["pairwise", "--signals", f"a={tmp_path / 'a'}", f"b={tmp_path / 'b'}", "--out", str(tmp_path / "kept"), "--replicates", "100", "--metric", "mae"]
    assert [(r.a, r.b) for r in cli.main(pair, spark).collect()] == [("a", "b")]
    with pytest.raises(cli.config.ConfigError):
        cli.main(["pairwise", "--signals", f"a={tmp_path / 'a'}", "--out", str(tmp_path / "kept")], spark)


def test_audit_and_statistics_of_day_files(spark, tmp_path, capsys):
    import json

    import numpy as np

    for day in ("20250101", "20250102"):
        (tmp_path / "x" / "train").mkdir(parents=True, exist_ok=True)
        np.save(tmp_path / "x" / "train" / f"{day}_features.npy", np.arange(20.0).reshape(10, 2))
        np.save(tmp_path / "x" / "train" / f"{day}_labels.npy", np.zeros(10, "i8") + 5 * (day == "20250102"))
        (tmp_path / "x" / "train" / f"{day}_metadata.json").write_text(json.dumps({"schema_version": "2.2", "n_features": 2}))
    assert [(r.day, r.problem) for r in cli.main(["audit", "--export", str(tmp_path / "x"), "--schema", "2.2"], spark).collect()] == [("20250102", "10 rows with labels other than -1, 0, 1")]
    assert len(cli.main(["audit", "--export", str(tmp_path / "x"), "--schema", "2.3"], spark).collect()) == 3
    stats = ["stats", "--export", str(tmp_path / "x"), "--out", str(tmp_path / "kept")]
    assert {r.idx: r.median for r in cli.main(stats, spark).collect()} == {0: 9.0, 1: 10.0}
    cli.main(stats, spark)
    assert "read" in capsys.readouterr().out
