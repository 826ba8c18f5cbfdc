"""Exports of .npy days: written by numpy, read by the data source, checked and labelled by the loader."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.load import load_split, returns_of_array, split_matrix
from tickloom.operators.validate import ContractError
from tickloom.sources.day_files import DayFilesReader, day_files, write_day_files

META = {"schema_version": "2.2", "n_features": 3, "horizons": [2, 4]}


def save(root, split, day, meta=META, **arrays):
    (root / split).mkdir(parents=True, exist_ok=True)
    for kind, x in arrays.items():
        np.save(root / split / f"{day}_{kind}.npy", x)
    if meta is not None:
        (root / split / f"{day}_metadata.json").write_text(json.dumps(meta, indent=1))


def sequences(n, seed=0, steps=5):
    return np.random.default_rng(seed).normal(size=(n, steps, 3)).astype("f4")


def load(spark, root, split="train", **more):
    return load_split(spark, str(root), split, "2.2", **more)


def test_rows_slices_and_types(spark, tmp_path):
    x, y = sequences(2500), np.random.default_rng(1).integers(-1, 2, (2500, 2)).astype("i1")
    save(tmp_path, "train", "20250203", sequences=x, labels=y)
    save(tmp_path, "train", "20250204", sequences=x[:3], labels=y[:3, 0])
    df = day_files(spark, str(tmp_path), rowsPerPartition="400")
    assert df.rdd.getNumPartitions() == 7 + 1
    rows = {(r.day, r.seq): r for r in df.collect()}
    assert len(rows) == 2503
    for (day, i), r in rows.items():
        np.testing.assert_array_equal(r.sequence, x[i].astype(float))
        assert r.features == x[i, -1].astype(float).tolist() and r.regression_labels is None
        assert r.labels == (y[i].tolist() if day == "20250203" else [y[i, 0]])


def test_only_what_is_asked_for_is_opened(spark, tmp_path):
    save(tmp_path, "train", "1", features=np.ones((4, 3)), labels=np.zeros(4, "i8"))
    save(tmp_path, "train", "2", features=np.ones((5, 3)), labels=np.zeros(5, "i8"))
    (tmp_path / "val").mkdir()
    (tmp_path / "val" / "1_features.npy").write_bytes(b"broken")
    assert day_files(spark, str(tmp_path)).where("split = 'train'").count() == 9
    assert day_files(spark, str(tmp_path)).where("split = 'train' AND day IN ('2')").count() == 5
    assert day_files(spark, str(tmp_path), split="train", day="1").count() == 4
    with pytest.raises(Exception):
        day_files(spark, str(tmp_path)).count()
    (tmp_path / "train" / "1_labels.npy").write_bytes(b"broken")
    reader = DayFilesReader({"path": str(tmp_path), "split": "train", "day": "2"}, ["seq", "features"])
    assert [(p.day, p.rows) for p in reader.partitions()] == [("2", 5)]


def test_headers_alone(spark, tmp_path):
    save(tmp_path, "train", "1", sequences=sequences(7), labels=np.zeros((7, 2), "i8"))
    path = tmp_path / "train" / "1_sequences.npy"
    path.write_bytes(path.read_bytes()[:128])  # the data are gone
    got = {(r.kind, tuple(r.shape)) for r in day_files(spark, str(tmp_path), headers=True).collect()}
    assert got == {("sequences", (7, 5, 3)), ("labels", (7, 2))}


def test_precomputed_labels_and_matrix(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    save(tmp_path, "train", "1", features=x, labels=np.array([-1, 0, 1, 0]), regression_labels=np.array([[1.0], [2], [3], [4]]))
    rows = sorted(load(spark, tmp_path).collect(), key=lambda r: r.seq)
    assert [(r.features, r.labels, r.regression_labels, r.label_source) for r in rows] == [(x[i].tolist(), [[-1], [0], [1], [0]][i], [i + 1.0], "precomputed") for i in range(4)]
    assert [r.features for r in split_matrix(spark, str(tmp_path), "train", [2, 0]).orderBy("seq").collect()] == [[v[2], v[0]] for v in x.tolist()]


@pytest.mark.parametrize("how", ["point_return", "smoothed_return", "mean_return", "peak_return"])
def test_labels_from_forward_prices(spark, tmp_path, how):
    k, width = 2, 8
    fp = 100 + np.random.default_rng(2).normal(size=(6, width))
    meta = META | {"forward_prices": {"exported": True, "smoothing_window_offset": k, "n_columns": width}}
    save(tmp_path, "train", "1", meta, features=np.ones((6, 3)), forward_prices=fp, labels=np.ones(6, "i8"))
    rows = sorted(load(spark, tmp_path, returns=how, threshold=30.0).collect(), key=lambda r: r.seq)

    def plain(p, h):
        now, ahead = p[k], p[k + 1 : k + h + 1]
        if how == "point_return":
            return (p[k + h] - now) / now * 1e4
        if how == "smoothed_return":
            return (p[h : k + h + 1].mean() - p[: k + 1].mean()) / p[: k + 1].mean() * 1e4
        if how == "mean_return":
            return (ahead.mean() - now) / now * 1e4
        return max(((v - now) / now * 1e4 for v in ahead), key=abs)

    want = [[plain(p, h) for h in (2, 4)] for p in fp]
    np.testing.assert_allclose([r.regression_labels for r in rows], want)
    assert [r.labels for r in rows] == [[int(v > 30) - int(v < -30) for v in w] for w in want]
    kept = load(spark, tmp_path, source="precomputed").collect()
    assert all(r.labels == [1] and r.label_source == "precomputed" for r in kept)
    assert [len(r.regression_labels) for r in load(spark, tmp_path, horizons=[1, 2, 5]).collect()] == [3] * 6


def test_rules_name_the_day(spark, tmp_path):
    good = {"features": np.ones((4, 3)), "labels": np.zeros(4, "i8")}
    odd, full = np.ones((4, 3)), np.ones((4, 98))
    odd[2, 1] = np.nan
    full[1, 5], full[1, 92] = np.inf, 0  # an invalid book may hold anything
    forward = {"forward_prices": {"exported": True, "smoothing_window_offset": 2, "n_columns": 6}}
    cases = {
        "schema version": (None, good, {}),
        "schema 1.0 is not 2.2": (META | {"schema_version": "1.0"}, good, {}),
        "not the one declared": (META | {"n_features": 5}, good, {}),
        "no labels of any kind": (META, {"features": np.ones((4, 3))}, {}),
        "differ in rows": (META, good | {"labels": np.zeros(3, "i8")}, {}),
        "asked for and not there": (META, good, {"source": "forward_prices"}),
        "not declared": (META, good | {"forward_prices": np.ones((4, 6))}, {"source": "forward_prices"}),
        "lies beyond": (META | forward, good | {"forward_prices": np.ones((4, 6))}, {}),
        "features that are not finite": (META, good | {"features": odd}, {}),
        "labels other than": (META, good | {"labels": np.array([0, 1, 2, 0])}, {}),
        "returns that are not finite": (META, good | {"regression_labels": np.array([0, 1, np.inf, 0])}, {}),
    }
    for i, (text, (meta, arrays, more)) in enumerate(cases.items()):
        root = tmp_path / str(i)
        save(root, "train", "20250101", **good)
        save(root, "train", "20250102", meta, **arrays)
        with pytest.raises(ContractError, match=f"20250102: .*{text}"):
            load(spark, root, **more)
    save(tmp_path / "w", "train", "1", **good)
    save(tmp_path / "w", "train", "2", META | {"n_features": 98}, features=full, labels=np.zeros(4, "i8"))
    with pytest.raises(ContractError, match="differs from the first"):
        load(spark, tmp_path / "w")
    save(tmp_path / "f", "train", "2", META | {"n_features": 98}, features=full, labels=np.zeros(4, "i8"))
    assert load(spark, tmp_path / "f").count() == 4
    with pytest.raises(FileNotFoundError):
        load(spark, tmp_path / "f", "val")


def test_written_exports_are_numpy_files(spark, tmp_path):
    rows = spark.range(5000).select(F.lit("train").alias("split"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("day"), F.col("id").alias("seq"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("x"), F.array((F.col("id") % 3 - 1)).alias("y"))
    for _ in range(2):
        write_day_files(rows.repartition(7), str(tmp_path), {"features": "x", "labels": "y"})
    for k in range(3):
        ids = np.arange(k, 5000, 3)
        np.testing.assert_array_equal(np.load(tmp_path / "train" / f"d{k}_features.npy"), np.c_[ids, np.full(len(ids), 0.5)])
        np.testing.assert_array_equal(np.load(tmp_path / "train" / f"d{k}_labels.npy"), ids[:, None] % 3 - 1)


def test_unknown_names(spark, tmp_path):
    with pytest.raises(ValueError):
        returns_of_array(F.array(), F.lit(0), F.lit(1), "other")
    with pytest.raises(ValueError):
        load(spark, tmp_path, source="other")
