import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evaluate, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for day in range(6):
        for seq in range(80):
            label = int(rng.integers(0, 3)) if seq % 2 else 0
            good = None if seq == 7 else float(label + rng.normal(0, 0.2))
            out.append((f"2024-01-0{day + 1}", seq, "train" if day < 3 else "val" if day < 5 else "test", label, good, float(rng.normal())))
    return spark.createDataFrame(out, "day string, seq long, split string, label int, good double, noise double").withColumn("day", F.to_date("day"))


def test_sweep_follows_plain_counts(spark, rows):
    got = {(r.name, r.split): (r.accuracy, r.n) for r in models.feature_sweep(rows, {"good": ["good"], "noise": ["noise"]}, 3).collect()}
    assert {n for n, _ in got} == {"class_prior", "previous_label", "logistic_good", "logistic_noise"} and len(got) == 12
    data = rows.orderBy("day", "seq").toPandas()
    major = data[data.split == "train"].label.mode().min()
    data["prev"] = data.groupby("day").label.shift(1).fillna(data.label).astype(int)
    for split, part in data.groupby("split"):
        assert got["class_prior", split] == (pytest.approx((part.label == major).mean()), len(part))
        assert got["previous_label", split] == (pytest.approx((part.label == part.prev).mean()), len(part))
        # Rows without the feature are left out.
        assert got["logistic_good", split][1] == part.good.notna().sum() and got["logistic_noise", split][1] == len(part)
        assert got["logistic_good", split][0] > 0.9 > got["logistic_noise", split][0]


def test_ledger_appends_and_never_raises(spark, tmp_path):
    record = spark.sql("SELECT 0.5D AS accuracy, 7 AS n, 'x' AS name")
    path = str(tmp_path / "ledger")
    assert evaluate.append_ledger(record, path, "a", "f1") and evaluate.append_ledger(record, path, "b", "f2")
    got = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert got == [(e, f, m, v) for e, f in (("a", "f1"), ("b", "f2")) for m, v in (("accuracy", 0.5), ("n", 7.0))]
    (tmp_path / "file").write_text("")
    assert not evaluate.append_ledger(record, str(tmp_path / "file" / "below"), "a", "f1")


def test_sweep_computes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        made.add(1)
        return float(x % 7)

    rows = spark.range(90).select(F.lit("d").alias("day"), F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("label"), F.when(F.col("id") < 60, "train").otherwise("test").alias("split"), slow("id").alias("a"), F.sin("id").alias("b"))
    got = models.feature_sweep(rows, {"one": ["a"], "both": ["a", "b"]}, 3).collect()
    assert len(got) == 8 and made.value == 90
