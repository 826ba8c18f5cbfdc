"""Calibration, baselines, decision gates and the experiment registry."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import content_hash, ratio
from ..sources.ticks import by_day, row_before, windowed

#: Target mean and deviation used where labels give none; fixed values.
STATIC_TARGET = (-0.167, 27.41)


def calibrate_variance(rows: DataFrame, pred: str = "yhat", label: str | None = "y", out: str = "calibrated", flat: float = 1e-10) -> DataFrame:
    """Adds ``out``: predictions moved to the mean and population deviation of the labels (or the static target).

    One aggregate of one row, broadcast. Raises if the predictions are constant.
    """
    mean, std = (F.avg(label), F.stddev_pop(label)) if label else (F.lit(STATIC_TARGET[0]), F.lit(STATIC_TARGET[1]))
    one = rows.agg(F.avg(pred).alias("_pm"), F.stddev_pop(pred).alias("_ps"), mean.alias("_tm"), std.alias("_ts"))
    ok = F.assert_true(F.coalesce(F.col("_ps") >= flat, F.lit(False)), F.lit("predictions are constant"))
    one = one.where(ok.isNull())
    return rows.join(F.broadcast(one)).withColumn(out, (F.col(pred) - F.col("_pm")) * (F.col("_ts") / F.col("_ps")) + F.col("_tm")).drop("_pm", "_ps", "_tm", "_ts")


def previous_label(label: str = "label") -> Column:
    """The label before (for ``windowed``, ``before`` 1); the first of a day predicts itself."""
    return F.coalesce(F.lag(label).over(by_day()), F.col(label))


def class_prior(rows: DataFrame, label: str = "label") -> DataFrame:
    """(majority, n, share): the most frequent class, of equal ones the smallest."""
    counts = rows.groupBy(F.col(label).alias("majority")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max_by("majority", F.struct("n", (-F.col("majority")).alias("m"))).alias("majority"), F.max("n").alias("n"), F.sum("n").alias("_all"))
    return best.select("majority", "n", (F.col("n") / F.col("_all")).alias("share"))


def baseline_report(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Accuracy of the model, of the class prior and of the previous label; improvements in percentage points."""
    hits = windowed(rows, {"_prev": previous_label(label)}, before=1).agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("model"), F.avg((F.col("_prev") == F.col(label)).cast("double")).alias("previous_label"))
    both = hits.join(class_prior(rows, label).select(F.col("share").alias("class_prior")))  # one row each
    return both.select("model", "class_prior", "previous_label", ((F.col("model") - F.col("class_prior")) * 100).alias("over_prior_pp"), ((F.col("model") - F.col("previous_label")) * 100).alias("over_previous_pp"))


def gates(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Adds passed_<metric> (at least its threshold; null fails) and passed."""
    flags = {m: F.coalesce(F.col(m) >= t, F.lit(False)) for m, t in thresholds.items()}
    every = F.lit(True)
    for f in flags.values():
        every = every & f
    return metrics.select("*", *[f.alias(f"passed_{m}") for m, f in flags.items()], every.alias("passed"))


def sweep(rows: DataFrame, predictions: dict[str, str], label: str = "label") -> DataFrame:
    """(name, accuracy, n) of several prediction columns: one scan."""
    each = rows.select(F.col(label).alias("_l"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("p")) for n, c in predictions.items()])).alias("_x"))
    return each.groupBy(F.col("_x.name").alias("name")).agg(F.avg((F.col("_x.p") == F.col("_l")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# Registry -------------------------------------------------------------------------------------------------------


def filter_experiments(experiments: DataFrame, model: str | None = None, strategy: str | None = None, tags: list[str] | None = None, least: dict[str, float] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Equal model and strategy, any of the tags, metrics at least (null fails), creation in a range of strings."""
    got = experiments
    if model is not None:
        got = got.where(F.col("model") == model)
    if strategy is not None:
        got = got.where(F.col("strategy") == strategy)
    if tags:
        got = got.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    for metric, low in (least or {}).items():
        got = got.where(F.col(metric) >= low)
    if since is not None:
        got = got.where(F.col("created") >= since)
    if until is not None:
        got = got.where(F.col("created") <= until)
    return got


def rank_experiments(experiments: DataFrame, metric: str, key: str = "id", top: int | None = None) -> DataFrame:
    """By falling metric (null as 0), then key; the best ``top``: a bounded heap per task, no global sort."""
    order = [F.coalesce(F.col(metric), F.lit(0.0)).desc(), F.col(key)]
    ranked = experiments.orderBy(*order)
    return ranked.limit(top) if top else ranked


def comparison_table(experiments: DataFrame, metrics: list[str], name: str = "name", width: int = 25, sort_by: str | None = None, ascending: bool = False, key: str = "id") -> DataFrame:
    """(line): names cut to ``width``, metrics with four decimals, padded columns; rows by one of the metrics (null as 0), then key."""
    if sort_by in metrics:
        value = F.coalesce(F.col(sort_by), F.lit(0.0))
        experiments = experiments.orderBy(value.asc() if ascending else value.desc(), key)
    cells = [F.rpad(F.substring(name, 1, width), width, " ")] + [F.lpad(F.coalesce(F.format_string("%.4f", F.col(m).cast("double")), F.lit("-")), 12, " ") for m in metrics]
    return experiments.select(F.concat_ws(" | ", *cells).alias("line"))


def registry_summary(experiments: DataFrame) -> DataFrame:
    """(kind, name, n): counts by model and by strategy in one pass."""
    each = experiments.select(F.explode(F.array(F.struct(F.lit("model").alias("kind"), F.col("model").alias("name")), F.struct(F.lit("strategy").alias("kind"), F.col("strategy").alias("name")))).alias("x")).select("x.*")
    return each.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def top_features(scores: DataFrame, k: int, score: str, key: str = "feature") -> DataFrame:
    """The ``k`` of largest size, with rank."""
    best = scores.orderBy(F.abs(score).desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(score).desc(), key)))  # at most k rows


def coefficient_direction(up: Column, down: Column, mark: float = 0.01) -> Column:
    return F.when(up > down + mark, "bullish").when(down > up + mark, "bearish").otherwise("neutral")


def experiment_id(name: Column, stamp: Column, *config: Column) -> Column:
    """name_timestamp_hash8; the stamp is an input, so that reruns agree."""
    return F.concat_ws("_", name, stamp, F.substring(content_hash(*config), 1, 8))


def flatten_metrics(metrics: DataFrame, prefix: str = "test_") -> DataFrame:
    """(metric, value): the numeric columns of a one-row record."""
    numeric = [f.name for f in metrics.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("x")).select("x.*")


def append_ledger(metrics: DataFrame, path: str, experiment: str, fingerprint: str) -> bool:
    """Append the numeric metrics of a one-row record to the ledger, rows of (experiment_id, fingerprint, metric, value).

    A ledger only observes: where it cannot be written, a warning is logged, nothing is raised and the result is false.
    """
    record = flatten_metrics(metrics, "").select(F.lit(experiment).alias("experiment_id"), F.lit(fingerprint).alias("fingerprint"), "metric", "value")
    try:
        record.write.mode("append").parquet(path)
    except Exception:
        logging.getLogger(__name__).warning("the ledger %s was not written", path, exc_info=True)
        return False
    return True


def signal_metadata(rows: DataFrame, model: str, experiment: str) -> DataFrame:
    """(json): distribution of the predictions, labels, prices and spreads of a signal table, with a content fingerprint."""
    stats = [f(F.col(c)).alias(f"{c}_{name}") for c in ("yhat", "y", "price", "spread") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), *stats)
    got = got.select("n", "first_day", "last_day", *[F.round(c, 6).alias(c) for c in got.columns[3:]])
    body = F.struct(F.lit(model).alias("model_type"), F.lit(experiment).alias("experiment_id"), *got.columns)
    return got.select(body.alias("b")).select(F.to_json(F.struct("b.*", F.sha2(F.to_json("b"), 256).alias("fingerprint"))).alias("json"))


def transition_report(rows: DataFrame, classes: int = 3, by: tuple[str, ...] = ("day",), keys: tuple[str, ...] = ("split",), label: str = "label", pred: str = "pred") -> DataFrame:
    """(keys, before, label, n, share, hit): how often each class follows each within ``by``, its share of the rows after
    ``before``, and the accuracy of the predictions there. Pairs of classes that don't occur have 0 rows."""
    seen = row_before(rows.select(*keys, *by, "seq", label, pred), label, "before", by).where(F.col("before").isNotNull())
    counts = seen.groupBy(*keys, "before", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("hit"))
    own = rows.sparkSession.range(classes)
    every = own.select(F.col("id").cast("int").alias("before")).crossJoin(own.select(F.col("id").cast("int").alias("label")))  # classes squared
    grid = seen.select(*keys).distinct().crossJoin(F.broadcast(every))
    got = grid.join(counts, [*keys, "before", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    after = F.sum("n").over(Window.partitionBy(*keys, "before"))  # a row per class
    return got.select(*keys, "before", "label", "n", ratio(F.col("n"), after).alias("share"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
