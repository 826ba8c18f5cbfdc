"""Cases whose results are known by hand, and rules that hold whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.scalar import argmax, finite, ratio, sign, softmax
from tickloom.operators import align, classification, evaluate, features, labels, models, monitor, normalize, regression, resample, validate

from tickloom.sources import ticks as ticks_module
from tickloom.sources.ticks import windowed

NAN, INF = float("nan"), float("inf")


def days(spark, *prices):
    rows = [(d, s, float(p)) for d, day in enumerate(prices) for s, p in enumerate(day)]
    return spark.createDataFrame(rows, "day int, seq long, price double")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*[c for c in ("day", "seq", "epoch", "label") if c in df.columns]).collect()]


def test_point_returns_end_with_the_day(spark):
    df = days(spark, [100, 101], [100, 99], [100, 100.5])
    got = values(windowed(df, {"y": labels.point_return(1)}, after=1), "y")
    assert [x[0] for x in got] == pytest.approx([100, None, -100, None, 50, None])


def test_forward_price_arrays_agree_with_leads(spark):
    df = days(spark, np.random.default_rng(0).uniform(90, 110, 30))
    both = windowed(df, {"fp": labels.forward_prices(5, 10), "y": labels.point_return(7)}, before=5, after=10).where("fp IS NOT NULL")
    assert both.count() == 15
    assert both.where(F.abs(F.col("y") - labels.returns_from_forward(F.col("fp"), 5, 7)) > 1e-9).count() == 0


def test_label_rules():
    assert [labels.label_shift(s) for s in ("tlob", "opportunity", "trend", "triple_barrier", "regression", None)] == [1, 1, 1, 0, 0, 1]
    assert labels.label_shift(None, "regression") == 0 and labels.label_shift(None, None, "classes 0, 1, 2") == 0
    assert labels.weight_horizon(None, [10, 60, 300]) == 300 and labels.weight_horizon(1, [10, 60, 300]) == 60 and labels.weight_horizon(5, [10, 60, 300]) is None
    assert labels.task_of("tlob") == "classification" and labels.task_of("other") == "regression"
    assert labels.label_source("auto", ["labels"]) == "precomputed" and labels.label_source("auto", ["forward_prices"]) == "forward_prices"
    with pytest.raises(ValueError):
        labels.label_source("precomputed", ["forward_prices"])
    with pytest.raises(ValueError):
        labels.horizon_slice(F.lit(None), [1, 2], -1)


def test_sample_weights_average_one(spark):
    got = [r.weight for r in labels.sample_weights(days(spark, range(1, 201)), 10).collect()]
    assert np.mean(got) == pytest.approx(1) and min(got) > 0 and max(got) > 1.5


def slow_weights(n, horizon, stride):
    spans = [range(i * stride, i * stride + horizon) for i in range(n)]
    cover = {}
    for s in spans:
        for t in s:
            cover[t] = cover.get(t, 0) + 1
    w = np.array([np.mean([1 / cover[t] for t in s]) for s in spans])
    return w / w.mean()


@pytest.mark.parametrize("horizon,stride", [(10, 1), (1, 1), (10, 3), (9, 3), (4, 10), (30, 4), (50, 7)])
def test_sample_weights_are_those_of_the_spans(spark, monkeypatch, horizon, stride):
    monkeypatch.setattr(ticks_module, "BLOCK", 11)
    df = days(spark, range(1, 38), range(1, 3), range(1, 100))
    got = {}
    for r in labels.sample_weights(df, horizon, stride).orderBy("day", "seq").collect():
        got.setdefault(r.day, []).append(r.weight)
    for day, n in ((0, 37), (1, 2), (2, 99)):
        assert got[day] == pytest.approx(list(slow_weights(n, horizon, stride)))


@pytest.mark.parametrize("block", [1, 7, 10])
def test_blocks_change_nothing(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    df = days(spark, rng.uniform(90, 110, 45), rng.uniform(90, 110, 3), rng.uniform(90, 110, 20)).withColumn("k", F.col("seq") % 5)
    stages = [
        {"y": labels.point_return(4), "s": labels.smoothed_return(6, 3), "pk": labels.peak_return(5), "m": labels.mean_return(5), "pl": labels.profit_labels(4, 6, 2, 1.0), "fp": labels.forward_prices(2, 6), "lr": features.log_return()},
        {"v": features.realized_vol("lr", 6), "sl": features.rolling_slope("price", 5), "sd": features.rolling_std("price", 5), "roc": features.rate_of_change("price", 5), "mo": features.momentum("price", 2, 6), "prev": evaluate.previous_label("k")},
    ]

    def rows():
        out = windowed(df, *stages, before=7, after=6).orderBy("day", "seq").collect()
        var = labels.forward_variance(df, 5, "fv").orderBy("day", "seq").collect()
        steps = features.sequences(df, F.array("price"), 4, 2).orderBy("day", "seq").collect()
        return [tuple(r) for part in (out, var, steps) for r in part]

    whole = rows()
    monkeypatch.setattr(ticks_module, "BLOCK", block)
    got = rows()
    assert len(got) == len(whole)
    for a, b in zip(got, whole):
        for x, z in zip(a, b):
            assert x == (pytest.approx(z) if isinstance(z, float) else z)


def test_days_are_numbered_over_slots(spark):
    import datetime

    rng = np.random.default_rng(2)
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(seconds=int(s)), k) for k, s in enumerate(rng.integers(0, 3 * 86400, 500))] + [(None, 900), (None, 901)]
    got = ticks_module.number_days(spark.createDataFrame(rows, "ts timestamp, id int"), "ts", "id").collect()
    want = {}
    for day in {r.day for r in got}:
        own = sorted((t, i) for t, i in rows if t and t.date() == day) if day else [(None, 900), (None, 901)]
        want |= {i: (day, k) for k, (_, i) in enumerate(own)}
    assert len(got) == len(rows) and {r.id: (r.day, r.seq) for r in got} == want


def test_trip_wire_over_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(d, s, float(rng.choice([-1, 0, 1])), float(rng.choice([-1, 1]))) for d in range(2) for s in range(200)]
    df = spark.createDataFrame(rows, "day int, seq long, y double, yhat double")
    whole = regression.hit_tripwire(df).first()
    old, ticks_module.BLOCK = ticks_module.BLOCK, 3
    try:
        assert list(regression.hit_tripwire(df).first()) == pytest.approx(list(whole))
    finally:
        ticks_module.BLOCK = old


def test_trip_wire_over_days(spark):
    y = [[1.0, -1.0, 1.0], [1.0, -1.0]]
    p = [[1.0, 1.0, 1.0], [1.0, -1.0]]
    df = spark.createDataFrame([(d, s, a, b) for d in range(2) for s, (a, b) in enumerate(zip(y[d], p[d]))], "day int, seq long, y double, yhat double")
    r = regression.hit_tripwire(df).first()
    assert (r.da, r.n) == (0.8, 5)


@pytest.mark.parametrize(
    "y,p,want",
    [
        ([5, 5, 5], [1, 2, 3], {"r2": 0.0}),
        ([0, 0, 0], [1, -1, 2], {"mae": 4 / 3, "rmse": math.sqrt(2), "directional_accuracy": 0.5, "profitable_accuracy": 0.0}),
        ([10, -10, 20], [1, -1, 1], {"profitable_accuracy": 1.0, "directional_accuracy": 1.0}),
        ([1, 2, 3], [3, 2, 1], {"r2": -3.0, "pearson": -1.0, "ic": -1.0}),
        ([1, 2], [1, 2], {"ic": None}),
        ([1, 2, 2, 4], [1, 1, 3, 2], {"ic": float(np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 4, 3])[0, 1])}),
    ],
)
def test_regression_metrics_by_hand(spark, y, p, want):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yhat double")
    got = regression.regression_metrics(df, []).first().asDict()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v)), k


def test_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200, 2000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.x: r.rank for r in regression.average_ranks(df, "x", [], "rank", buckets=16).distinct().collect()}
    order = np.sort(x)
    for v in np.unique(x):
        at = np.flatnonzero(order == v) + 1
        assert got[v] == at.mean()


def test_p_values():
    assert regression.correlation_p_value(0.5, 20) == pytest.approx(0.024769, abs=1e-5)
    assert regression.correlation_p_value(0.0, 20) == pytest.approx(1.0) and regression.correlation_p_value(0.9, 2) == 1.0


def test_out_of_range_classes_count_against_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 7), (9, 9)], "label int, pred int")
    assert classification.confusion_matrix(df, 3).agg(F.sum("n")).first()[0] == 2
    r = classification.macro_metrics(df, 3).first()
    assert r.accuracy == 0.75 and r.macro_recall == pytest.approx(2 / 3)


def test_metrics_of_empty_input_are_zero(spark):
    empty = spark.createDataFrame([], "label int, pred int")
    assert all(v == 0 for v in classification.all_metrics(empty, "tlob").first().asDict().values())
    assert classification.class_names("tlob", 3) == ["Down", "Stable", "Up"] and classification.class_names("x", 2) == ["Class_0", "Class_1"]


def test_metrics_ignore_row_order_and_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 3, (300, 2))], "label int, pred int")
    for f in classification.STRATEGY_METRICS.values():
        assert f(df).first() == f(df.repartition(7).orderBy("pred")).first()


def test_transition_accuracy_needs_a_change(spark):
    df = spark.createDataFrame([(0, k, 1, 1) for k in range(4)], "day int, seq int, label int, pred int")
    assert classification.transition_accuracy(df).first().transition_accuracy == 0


def test_scalar_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (NAN, 2.0), (INF, 3.0), (None, 1.0)], "a double, b double")
    got = df.select(ratio(F.col("a"), F.col("b")).alias("r"), finite(F.col("a")).alias("f"), sign(F.lit(-0.0)).alias("s")).collect()
    assert got[0].r == 0 and [x.f for x in got] == [True, False, False, False] and got[0].s == 0
    r = spark.createDataFrame([([1000.0, 1000.0, -5.0],)], "z array<double>").select(softmax(F.col("z")).alias("p"), argmax(F.col("z")).alias("m")).first()
    assert r.p == pytest.approx([0.5, 0.5, 0]) and r.m == 0


def test_normalizing_skips_what_is_not_finite(spark):
    rows = [([1.0, 10.0, NAN, 5.0],), ([3.0, 30.0, 2.0, 5.0],), ([INF, 20.0, 4.0, 5.0],)]
    df = spark.createDataFrame(rows, "features array<double>")
    got = {r.idx: r for r in normalize.feature_statistics(df, []).collect()}
    assert got[0].mean == 2 and got[0].n == 2 and got[1].median == 20 and got[3].std == 1e-8
    h = {r.idx: r for r in normalize.hybrid_stats(df, ([0], [1]), (2,)).collect()}
    assert (h[2].mean, h[2].std, h[3].std) == (0, 1, 1)
    with pytest.raises(ValueError):
        normalize.require_finite_columns(spark.createDataFrame([([1.0, NAN],)], "features array<double>"))
    assert normalize.layout("FI2010") == normalize.LAYOUTS["lobster"] and normalize.layout("extended_grouped")[0][10] == 20
    with pytest.raises(ValueError):
        normalize.layout("other")


def test_statistics_are_cached_with_their_parameters(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3).select(F.col("id").alias("idx"))

    for parameters in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert normalize.cached_stats(spark, str(tmp_path / "s"), compute, parameters).count() == 3
    assert len(calls) == 2


def test_feature_selection_rules(spark):
    for bad in ([], [1, 1], [-1], [64]):
        with pytest.raises(ValueError):
            features.check_indices(bad, 64)
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "f array<double>")
    assert df.select(features.select_features(F.col("f"), [2, 0], 3)).first()[0] == [3, 1]
    assert df.select(features.select_features(F.col("f"), [0, 1, 2], 3)).first()[0] == [1, 2, 3]
    assert {k: len(v) for k, v in features.PRESETS.items()}["no_meta"] == 92


def test_feature_set_records():
    import hashlib
    import json

    body = {"indices": [1, 5], "source_feature_count": 98, "contract_version": "2"}
    record = body | {"name": "n", "description": "", "content_hash": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}
    assert features.load_feature_set(json.dumps(record), "2")["indices"] == [1, 5]
    for change in ({"content_hash": "0"}, {"indices": [1]}):
        with pytest.raises(ValueError):
            features.load_feature_set(json.dumps(record | change))
    with pytest.raises(ValueError):
        features.load_feature_set(json.dumps(record), "3")


def test_book_valid_falls_back_to_all_rows(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [0.0]), (2, [0.0]), (2, [0.2])], "day int, features array<double>")
    got = features.book_valid(df, 0).groupBy("day").count().collect()
    assert {r.day: r["count"] for r in got} == {1: 1, 2: 2}


def test_rolling_features_need_a_full_frame(spark):
    df = days(spark, range(1, 8), range(1, 4))
    got = values(windowed(df, {"m": features.rolling_mean("price", 5), "s": features.rolling_slope("price", 5)}, before=4), "m", "s")
    assert got[4] == pytest.approx((3, 1)) and got[3] == (None, None) and got[-1] == (None, None)


@pytest.mark.parametrize("a,b,want", [(100, 100, 100), (50, 80, 50), (80, 50, 50)])
def test_alignment_trims_to_the_shorter(spark, a, b, want):
    got = align.align({"x": days(spark, range(a)), "y": days(spark, range(b))}, "y", ["price"])
    assert got.columns == ["day", "seq", "y_price", "x_price"] and got.count() == want
    if a != b:
        with pytest.raises(ValueError):
            align.require_aligned(days(spark, range(a)), days(spark, range(b)))


def test_alignment_errors(spark):
    with pytest.raises(ValueError):
        align.require_common_days(days(spark, [1]), days(spark, [1]).withColumn("day", F.lit(9)))
    df = spark.createDataFrame([(0, k, float(k), NAN if k < 10 else 1.0) for k in range(100)], "day int, seq long, y double, p double")
    with pytest.raises(ValueError):
        align.drop_nonfinite(df, ["y", "p"])
    kept, share = align.drop_nonfinite(df, ["y", "p"], 0.2)
    assert kept.count() == 90 and share == pytest.approx(0.1)
    a = df.withColumn("yhat", F.lit(0.0))
    with pytest.raises(ValueError):
        align.paired({"a": a, "b": a.withColumn("y", F.col("y") + 1)})
    assert align.pairs(["c", "a", "b"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert align.subsample(df, 7, 1, ["day", "seq"]).collect() == align.subsample(df.repartition(5), 7, 1, ["day", "seq"]).collect()


def test_calibration_keeps_order_and_matches_moments(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(200, 2)) * [3, 30] + [1, 5]], "yhat double, y double")
    got = evaluate.calibrate_variance(df)
    r = got.agg(F.avg("calibrated"), F.stddev_pop("calibrated"), F.avg("y"), F.stddev_pop("y")).first()
    assert r[0] == pytest.approx(r[2]) and r[1] == pytest.approx(r[3])
    ic = lambda p: regression.spearman(got, p, "y", []).first().ic
    assert ic("calibrated") == pytest.approx(ic("yhat"))
    with pytest.raises(Exception, match="predictions are constant"):
        evaluate.calibrate_variance(df.withColumn("yhat", F.lit(1.0))).collect()


def test_baselines(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([2, 2, 0, 1, 1])], "day int, seq int, label int")
    assert [r[0] for r in windowed(df, {"p": evaluate.previous_label()}, before=1).orderBy("seq").select("p").collect()] == [2, 2, 2, 0, 1]
    assert evaluate.class_prior(df).first().majority == 1


def test_registry_rules(spark):
    df = spark.createDataFrame([(1, "m", ["a", "b"], 0.5, "2024-01-02"), (2, "m", ["c"], None, "2024-02-01"), (3, "n", ["a"], 0.7, "2024-03-01")], "id int, model string, tags array<string>, accuracy double, created string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(evaluate.filter_experiments(df, tags=["a", "z"])) == [1, 3] and ids(evaluate.filter_experiments(df, least={"accuracy": 0.1})) == [1, 3]
    assert ids(evaluate.filter_experiments(df, model="m", since="2024-01-15")) == [2]
    assert [r.id for r in evaluate.rank_experiments(df, "accuracy", top=2).collect()] == [3, 1]


def test_block_lengths():
    assert resample.block_length(8085) == 21 and resample.block_length(27) == 3 and resample.block_length(10, 4) == 4
    with pytest.raises(ValueError):
        resample.block_length(5, 5)


def test_block_sums_are_those_of_the_rows(spark):
    x = np.random.default_rng(0).normal(size=57)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, x double")
    got = {r.start: r.s for r in resample.block_sums(df, {"s": F.col("x")}, 5).collect()}
    assert got.keys() == set(range(53)) and all(got[k] == pytest.approx(x[k : k + 5].sum()) for k in got)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p double")
    got = {r.t: r.q for r in resample.benjamini_hochberg(df, "p", ["t"]).collect()}
    assert [got[k] for k in "abcd"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_purged_folds(spark):
    got = resample.purged_folds(spark.range(10).select(F.col("id").alias("day")), 5, 1).collect()
    by = {(r.fold, r.day): r.role for r in got}
    assert by[(0, 0)] == by[(0, 1)] == "val" and by[(0, 2)] == "purged" and by[(0, 3)] == "train" and by[(4, 7)] == "train"


def test_importance_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 400))
    df = spark.createDataFrame([(k, float(x), float(z), float(x)) for k, (x, z) in enumerate(zip(a, b))], "i long, a double, b double, y double")
    got = {r.feature: r.importance for r in resample.permutation_importance(df, ["a", "b"], "y", F.col("a"), resample.metric_for_task("regression"), 400, 3).collect()}
    assert got["a"] > 0.7 and got["b"] == pytest.approx(0)
    with pytest.raises(ValueError):
        resample.permutation_importance(df, ["a"], "y", F.col("a"), resample.metric_for_task("regression"), 400, 1, length=300)


def test_early_stopping_moves_its_best_on_improvements_only(spark):
    losses = [1, 0.95, 0.91, 0.87, 0.83, 0.79, 0.80, 0.78, 0.79]
    log = spark.createDataFrame([("r", e, float(v)) for e, v in enumerate(losses)], "run string, epoch int, val_loss double")
    best, waited, stop, want = math.inf, 0, False, []
    for v in losses:
        better = v < best - 0.08
        best, waited = (v, 0) if better else (best, waited + 1)
        stop = stop or waited >= 3
        want.append((better, best, waited, stop))
    got = monitor.early_stopping(log, min_delta=0.08).orderBy("epoch").collect()
    assert [(r.improved, r.best, r.waited, r.stop) for r in got] == want
    assert [r.improved for r in got[:3]] == [True, False, True]


def test_merged_moments_hold_far_from_zero(spark):
    from tickloom.streaming.moments import batch_moments, finish_moments, merge_moments

    x = np.random.default_rng(0).normal(1e9, 2, 200)
    df = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(x)], "part int, x double").withColumn("key", F.lit(1))
    r = finish_moments(merge_moments(batch_moments(df, ["key", "part"], "x"), ["key"])).first()
    assert r.n == 200 and r.mean == pytest.approx(x.mean()) and r.std == pytest.approx(x.std(), rel=1e-6)


def test_intervals_and_metrics_are_checked(spark):
    good = spark.createDataFrame([("a", 1.0, 0.5, 2.0)], "metric string, estimate double, low double, high double")
    resample.require_sound(good)
    for bad in (good.withColumn("estimate", F.lit(3.0)), good.withColumn("low", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="not sound"):
            resample.require_sound(bad)
    with pytest.raises(ValueError, match="not finite"):
        resample.require_finite(good.withColumn("low", F.lit(NAN)), ["low"])
    for wrong in ({"metrics": ("nope",)}, {"metrics": ()}, {"replicates": 5}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            resample.bootstrap_ci(good, "low", "high", 100, **wrong)
    with pytest.raises(ValueError):
        resample.metric_for_task("ranking")
    df = spark.createDataFrame([(1, [0.1, 0.9]), (0, [0.2, 0.8])], "y int, _score array<double>")
    assert resample.metric_for_task("classification")(df, []).first().value == 0.5


def test_differences_and_screening(spark):
    days_of = lambda *x: spark.createDataFrame([(d,) for d in x], "day int")
    assert sorted(r.day for r in align.days_without(days_of(1, 2, 2, 3), days_of(3, 4)).collect()) == [1, 2]
    assert align.name_differences(["a", "b"], ["b", "c"]) == {"missing": ["a"], "unexpected": ["c"]}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(*map(float, r), float(r[0] + rng.normal()), float(-r[1]), 1.0) for r in x], "a double, b double, c double, u double, v double, flat double")
    got = {(r.horizon, r.feature): r for r in regression.screening(df, ["a", "b", "flat"], {10: "u", 20: "v"}).collect()}
    assert got[10, "a"].rank == 1 and got[20, "b"].rank == 1 and got[20, "b"].direction == "-" and got[20, "b"].best and got[10, "a"].best
    assert got[10, "flat"].p == 1.0 and got[10, "flat"].r == 0 and got[10, "flat"].place is None and got[20, "b"].p == 0.0 and got[10, "a"].p < 1e-10
    with pytest.warns(UserWarning, match="smoothed"):
        assert labels.warn_if_smoothed("smoothed_return")
    assert not labels.warn_if_smoothed("point_return")


def test_temporal_set_is_checked():
    with pytest.raises(ValueError):
        features.TemporalSet(("a",), (), (), (), top=2)
    with pytest.raises(ValueError):
        features.TemporalSet(("a", "b", "c"), (), (), (), windows=(1,))


def test_monitoring_rules(spark):
    log = spark.createDataFrame([("r", e, v, t) for e, (v, t) in enumerate([(5.0, 9.0), (4.0, 8.0), (4.5, 7.0), (4.6, 6.0), (4.7, 5.0), (3.0, 4.0)])], "run string, epoch int, val_loss double, train_loss double")
    stop = [r.stop for r in monitor.early_stopping(log).orderBy("epoch").collect()]
    assert stop == [False] * 4 + [True, True]
    assert [r.overfit for r in monitor.overfit_flags(log).orderBy("epoch").collect()] == [False, False, False, True, True, False]
    saved = [r.save for r in monitor.checkpoint_decisions(log, every=3, best_only=False).orderBy("epoch").collect()]
    assert saved == [True, True, True, False, False, True]
    assert [r.save for r in monitor.checkpoint_decisions(log, best_only=True).orderBy("epoch").collect()] == [True, True, False, False, False, True]
    assert sorted(r.epoch for r in monitor.keep_last(log, 2).collect()) == [4, 5]
    with pytest.raises(monitor.TrainingDiverged):
        monitor.require_finite_losses(log.withColumn("loss", F.when(F.col("epoch") == 2, NAN).otherwise(1.0)))
    flat = spark.createDataFrame([("r", e, 1.0) for e in range(8)], "run string, epoch int, val_loss double")
    assert [round(r.lr, 3) for r in monitor.plateau_rates(flat, 0.1).orderBy("epoch").collect()] == [0.1] * 6 + [0.05] * 2


def test_validation_errors(spark):
    meta = spark.createDataFrame([("d1", "1", 98, [10, 60]), ("d2", "1", 98, [10, 60])], "day string, schema_version string, n_features int, horizons array<int>")
    validate.require_metadata(meta, "1", 98)
    assert validate.horizons_of(meta) == [10, 60]
    for bad in (meta.limit(0), meta.withColumn("schema_version", F.lit(None).cast("string")), meta.withColumn("n_features", F.when(F.col("day") == "d1", 5).otherwise(6))):
        with pytest.raises(validate.ContractError):
            validate.require_metadata(bad, "1")
    with pytest.raises(validate.ContractError):
        validate.horizons_of(meta.withColumn("horizons", F.when(F.col("day") == "d1", F.array(F.lit(1))).otherwise(F.array(F.lit(2)))))
    with pytest.raises(validate.ContractError):
        validate.require_finite(spark.createDataFrame([(1.0,), (NAN,)], "x double"), ["x"])
    assert validate.check_setup({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b: expected 2, found 3"]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=100) + 3
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = models.fit_ridge(df, ["a", "b", "c"], "y", alpha=5.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert list(model.coefficients) == pytest.approx(np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc), abs=1e-8)


def test_scoring_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    got = models.score_with(df, lambda x: x["a"] + 10 * x["b"], ["a", "b"])
    assert [r.yhat for r in got.orderBy("a").collect()] == [21, 43]
    with pytest.raises(Exception, match="not finite"):
        models.require_finite_for_scoring(df.withColumn("a", F.lit(NAN)), ["a"]).collect()
    with pytest.raises(ValueError):
        models.strategy_of("mlp", "pinball", "regression")
    assert models.strategy_of("hmhp", "ce", "classification") == "hmhp_classification"
