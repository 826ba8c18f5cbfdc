import pytest

from tickloom.plans import config


def write(path, text):
    path.write_text(text)
    return path


def test_bases_merge_left_to_right(tmp_path):
    write(tmp_path / "a.yaml", "_partial: true\ndata: {clip: 5.0, labels: {horizons: [10, 60]}}\ntags: [x, y]\n")
    write(tmp_path / "b.yaml", "data: {clip: 7.0}\n")
    top = write(tmp_path / "c.yaml", "_base: [a.yaml, b.yaml]\nname: run\ntags: [z]\ndata: {labels: {primary_index: 1}}\n")
    got = config.load(top)
    assert got.data.clip == 7.0 and got.data.labels.horizons == (10, 60) and got.data.labels.primary_index == 1 and got.tags == ("z",)
    assert got.warnings() == ["hypothesis is missing"]


def test_cycles_and_depth_are_errors(tmp_path):
    write(tmp_path / "a.yaml", "_base: b.yaml\n")
    with pytest.raises(config.ConfigError):
        config.resolve(write(tmp_path / "b.yaml", "_base: a.yaml\n"))
    for k in range(14):
        write(tmp_path / f"l{k}.yaml", f"_base: l{k + 1}.yaml\n" if k < 13 else "name: x\n")
    with pytest.raises(config.ConfigError):
        config.resolve(tmp_path / "l0.yaml")


@pytest.mark.parametrize("bad", [{"nam": 1}, {"data": {"clip": -1}}, {"data": {"labels": {"horizons": [10], "primary_index": 3}}}, {"model": {"kind": "other"}}, {"train": {"epochs": 0}}, {"cv": {"folds": 1}}, {"data": {"preset": "full", "indices": [1]}}])
def test_rules(bad):
    with pytest.raises(config.ConfigError):
        config.build(config.Experiment, bad)


def test_overrides_and_fingerprints():
    base = config.Experiment()
    got = config.override(base, {"train.epochs": 3, "data.labels.threshold_bps": 4.0})
    assert got.train.epochs == 3 and got.data.labels.threshold_bps == 4.0 and base.train.epochs == 50
    assert config.fingerprint(base) != config.fingerprint(got) == config.fingerprint(config.override(base, {"data.labels.threshold_bps": 4.0, "train.epochs": 3}))
    config.require_same(config.fingerprint(got), got)
    with pytest.raises(config.ConfigError):
        config.require_same("0", got)
    with pytest.raises(config.ConfigError):
        config.override(base, {"train.other": 3})
