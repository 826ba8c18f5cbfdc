"""Training logs as relations: (run, epoch, ...) rows; every rule is a window over a run's epochs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite

def by_run() -> WindowSpec:
    return Window.partitionBy("run").orderBy("epoch")


def so_far() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, -1)


class TrainingDiverged(RuntimeError):
    """A loss is not finite; says of which ``run`` and ``epoch``, and its ``value``."""

    def __init__(self, run, epoch, value, what: str = "the loss"):
        self.run, self.epoch, self.value = run, epoch, value
        super().__init__(f"run {run}, epoch {epoch}: {what} is not finite ({value})")


class MonitorUndefined(TrainingDiverged):
    """A monitored ``metric`` is not finite, so that no epoch could be better or worse by it."""

    def __init__(self, run, epoch, value, metric: str):
        self.metric = metric
        super().__init__(run, epoch, value, metric)


def require_finite_losses(log: DataFrame, loss: str = "loss") -> None:
    """Raises with the first epoch whose loss is not finite."""
    bad = log.where(~finite(F.col(loss))).orderBy("run", "epoch").first()
    if bad is not None:
        raise TrainingDiverged(bad.run, bad.epoch, bad[loss])


def require_defined(log: DataFrame, metric: str = "val_loss") -> None:
    """Raises with the first epoch whose monitored metric is null or not finite."""
    bad = log.where(~F.coalesce(finite(F.col(metric)), F.lit(False))).orderBy("run", "epoch").first()
    if bad is not None:
        raise MonitorUndefined(bad.run, bad.epoch, bad[metric], metric)


def early_stopping(log: DataFrame, loss: str = "val_loss", patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """Adds improved, best, waited and stop.

    An epoch improves if it lies more than ``min_delta`` below the best so far, and only then it becomes the best: steps
    smaller than that don't add up to a new best by themselves, but together they may pass the old one. ``waited`` counts
    the run's epochs since the last improvement, ``stop`` holds from the first time it reaches ``patience``. A run's epochs
    are folded in order, as one array; null and NaN never improve.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    runs = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").alias("e"), row.alias("row")))).alias("_log"))
    kept = F.struct(F.lit(True).alias("improved"), F.lit(0.0).alias("best"), F.lit(0).alias("waited"), F.lit(False).alias("stop"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(False).alias("stop"), F.slice(F.array(kept), 1, 0).alias("out"))

    def step(held, epoch):
        now = epoch["row"][loss].cast("double")
        better = F.coalesce(finite(now) & (held["best"].isNull() | (now < held["best"] - min_delta)), F.lit(False))
        waited = F.when(better, 0).otherwise(held["waited"] + 1)
        best, stop = F.when(better, now).otherwise(held["best"]), held["stop"] | (waited >= patience)
        one = F.struct(better.alias("improved"), best.alias("best"), waited.alias("waited"), stop.alias("stop"))
        return F.struct(best.alias("best"), waited.alias("waited"), stop.alias("stop"), F.concat(held["out"], F.array(one)).alias("out"))

    folded = runs.select("_log", F.aggregate("_log", start, step, lambda held: held["out"]).alias("_out"))
    return folded.select(F.explode(F.arrays_zip("_log", "_out")).alias("x")).select("x._log.row.*", "x._out.*")


def overfit_flags(log: DataFrame, train: str = "train_loss", val: str = "val_loss") -> DataFrame:
    """Adds overfit: the last three training losses don't rise and the last three validation losses don't fall."""
    t, v = F.col(train), F.col(val)
    t1, t2, v1, v2 = F.lag(t, 1).over(by_run()), F.lag(t, 2).over(by_run()), F.lag(v, 1).over(by_run()), F.lag(v, 2).over(by_run())
    return log.withColumn("overfit", F.coalesce((t2 >= t1) & (t1 >= t) & (v2 <= v1) & (v1 <= v), F.lit(False)))


def health_flags(log: DataFrame, loss: str = "loss", score: str = "accuracy", patience: int = 5, blowup: float = 2.0, poor: float = 0.35) -> DataFrame:
    """Adds stagnant (epochs since the best score), diverged (loss over ``blowup`` x the first) and weak (poor score after epoch 3)."""
    best = F.max_by("epoch", F.struct(score, (-F.col("epoch")).alias("e"))).over(so_far())
    got = log.withColumn("stagnant", F.col("epoch") - best >= patience)
    got = got.withColumn("diverged", F.col(loss) > blowup * F.first(loss).over(so_far()))
    return got.withColumn("weak", (F.col("epoch") > 3) & (F.col(score) < poor))


def gradient_summary(log: DataFrame, norm: str = "grad_norm") -> DataFrame:
    """Per epoch of (run, epoch, layer, norm): total norm, mean, deviation, range and counts of NaN and Inf."""
    x = F.when(finite(F.col(norm)), F.col(norm))
    return log.groupBy("run", "epoch").agg(F.sqrt(F.sum(x * x)).alias("total_norm"), F.avg(x).alias("mean_norm"), F.stddev_pop(x).alias("std_norm"), F.max(x).alias("max_norm"), F.min(x).alias("min_norm"), count_if(F.isnan(norm)).alias("n_nan"), count_if(F.abs(norm) == float("inf")).alias("n_inf"))


def learning_rate(epoch: Column, epochs: int, lr: float, kind: str = "cosine", step: int = 10, gamma: float = 0.1) -> Column:
    """The rate at an epoch (from 0): cosine, step or none."""
    rates = {
        "cosine": 0.5 * lr * (1 + F.cos(math.pi * epoch / epochs)),
        "step": lr * F.pow(F.lit(gamma), F.floor(epoch / step)),
        "none": F.lit(lr),
    }
    return rates[kind].cast("double")


def learning_rates(spark: SparkSession, epochs: int, lr: float, kind: str = "cosine", step: int = 10, gamma: float = 0.1) -> DataFrame:
    """(epoch, lr) of a schedule."""
    rows = spark.range(epochs).select(F.col("id").cast("int").alias("epoch"))
    return rows.select("epoch", learning_rate(F.col("epoch"), epochs, lr, kind, step, gamma).alias("lr"))


def plateau_rates(log: DataFrame, lr: float, loss: str = "val_loss", factor: float = 0.5, patience: int = 5) -> DataFrame:
    """Adds lr: cut by ``factor`` for every full ``patience`` epochs without a new best since the last best."""
    best_before = F.min(loss).over(before())
    got = log.withColumn("_new", best_before.isNull() | (F.col(loss) < best_before))
    got = got.withColumn("_since", F.col("epoch") - F.max(F.when(F.col("_new"), F.col("epoch"))).over(so_far()))
    cut = ((F.col("_since") > 0) & (F.col("_since") % (patience + 1) == 0)).cast("int")
    return got.withColumn("lr", lr * F.pow(F.lit(factor), F.sum(cut).over(so_far()))).drop("_new", "_since")


def checkpoint_decisions(log: DataFrame, loss: str = "val_loss", every: int = 5, best_only: bool = False) -> DataFrame:
    """Adds is_best and save: an improvement, or every n epochs unless only the best are kept."""
    best_before = F.min(loss).over(before())
    got = log.withColumn("is_best", best_before.isNull() | (F.col(loss) < best_before))
    due = F.lit(False) if best_only else (F.col("epoch") + 1) % every == 0
    return got.withColumn("save", F.col("is_best") | due)


def keep_last(checkpoints: DataFrame, n: int) -> DataFrame:
    """The last ``n`` saved epochs of each run."""
    return checkpoints.withColumn("_k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("epoch")))).where(F.col("_k") <= n).drop("_k")


def history(log: DataFrame, logs: str = "logs", pattern: str = "precision|recall|f1") -> DataFrame:
    """(run, epoch, metric, value): the entries of a map of logs whose key matches."""
    kept = F.map_filter(logs, lambda k, v: k.rlike(pattern))
    return log.select("run", "epoch", F.explode(kept).alias("metric", "value"))


