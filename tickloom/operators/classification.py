"""Classification metrics: one pass over (label, prediction), in which all counts are conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if, ratio, share
from ..sources.shared import materialize
from ..sources.ticks import row_before
from .quantiles import exact_quantiles, with_quantiles

#: Names of the classes by labelling strategy.
CLASS_NAMES = {
    "triple_barrier": ("StopLoss", "Timeout", "ProfitTarget"),
    "opportunity": ("BigDown", "NoOpportunity", "BigUp"),
    "tlob": ("Down", "Stable", "Up"),
    "trend": ("Down", "Stable", "Up"),
    "binary": ("NoSignal", "Signal"),
}


def class_names(strategy: str, classes: int) -> list[str]:
    names = CLASS_NAMES.get(strategy, ())
    return list(names) if len(names) == classes else [f"Class_{c}" for c in range(classes)]


def name_class(label: Column, strategy: str, classes: int) -> Column:
    names = F.array(*[F.lit(n) for n in class_names(strategy, classes)])
    return F.get(names, label.cast("int"))


def confusion_matrix(rows: DataFrame, classes: int, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n) with all classes x classes cells; rows outside them are left out."""
    inside = F.col(label).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    counts = rows.where(inside).groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("label"), (F.col("id") % classes).cast("int").alias("pred"))
    return cells.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(rows: DataFrame, classes: int, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support, predicted) per class; 0 where a denominator is 0."""
    m = confusion_matrix(rows, classes, label, pred)
    tp = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    by_label = m.groupBy("label").agg(tp.alias("tp"), F.sum("n").alias("support"))
    by_pred = m.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    got = by_label.join(by_pred, "label").withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return got.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support", "predicted")


def accuracy(label: Column, pred: Column) -> Column:
    return share(label == pred)


def macro_metrics(rows: DataFrame, classes: int, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy over all rows (also those outside the classes) and unweighted means over the classes."""
    macro = class_report(rows, classes, label, pred).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    whole = rows.agg(accuracy(F.col(label), F.col(pred)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return whole.join(macro)  # one row each


def _outer(c: Column) -> Column:
    return c.isin(0, 2)


def triple_barrier_metrics(rows: DataFrame) -> DataFrame:
    label, pred = F.col("label"), F.col("pred")
    return rows.agg(
        share(_outer(pred)).alias("signal_rate"),
        share(_outer(label)).alias("true_signal_rate"),
        share(_outer(pred)).alias("decisive_prediction_rate"),
        share(_outer(label)).alias("true_decisive_rate"),
        ratio(count_if(label == 2), count_if(_outer(label))).alias("true_win_rate"),
        ratio(count_if((label == 2) & _outer(pred)), count_if(_outer(pred))).alias("predicted_trade_win_rate"),
    )


def opportunity_metrics(rows: DataFrame) -> DataFrame:
    label, pred = F.col("label"), F.col("pred")
    return rows.agg(
        share(_outer(pred)).alias("signal_rate"),
        share(_outer(label)).alias("true_signal_rate"),
        share(_outer(pred)).alias("opportunity_prediction_rate"),
        share(_outer(label)).alias("true_opportunity_rate"),
        ratio(count_if(_outer(pred) & (label == pred)), count_if(_outer(pred))).alias("directional_accuracy"),
    )


def tlob_metrics(rows: DataFrame) -> DataFrame:
    label, pred = F.col("label"), F.col("pred")
    return rows.agg(
        share(_outer(pred)).alias("signal_rate"),
        share(_outer(label)).alias("true_signal_rate"),
        ratio(count_if(_outer(pred) & (label == pred)), count_if(_outer(pred))).alias("directional_accuracy"),
    )


def trading_metrics(rows: DataFrame) -> DataFrame:
    label, pred = F.col("label"), F.col("pred")
    return rows.agg(
        share(_outer(pred)).alias("signal_rate"),
        ratio(count_if(_outer(pred) & (label == pred)), count_if(_outer(pred))).alias("directional_accuracy"),
        ratio(count_if((pred == 2) & (label == 2)), count_if(pred == 2)).alias("up_precision"),
        ratio(count_if((pred == 0) & (label == 0)), count_if(pred == 0)).alias("down_precision"),
    )


STRATEGY_METRICS = {"triple_barrier": triple_barrier_metrics, "opportunity": opportunity_metrics, "tlob": tlob_metrics, "trend": tlob_metrics}


def all_metrics(rows: DataFrame, strategy: str, classes: int = 3) -> DataFrame:
    """One row: accuracy, macro metrics and those of the strategy."""
    got = macro_metrics(rows, classes)
    return got.join(STRATEGY_METRICS[strategy](rows)) if strategy in STRATEGY_METRICS else got


def transition_accuracy(rows: DataFrame, by: tuple[str, ...] = ("day",), label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy over the rows whose label differs from the one before, in the order of seq; 0 without such rows."""
    changed = row_before(rows.select(*by, "seq", label, pred), label, "_before", by).where(F.col(label) != F.col("_before"))
    return changed.agg(accuracy(F.col(label), F.col(pred)).alias("transition_accuracy"), F.count(F.lit(1)).alias("n_transitions"))


def class_weights(rows: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """(label, n, weight, focal_weight): total / (classes x max(n, 1)), and the same scaled to sum to ``classes``."""
    known = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    counts = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    got = known.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy()  # one row per class
    got = got.withColumn("weight", F.sum("n").over(every) / (classes * F.greatest("n", F.lit(1))))
    return got.withColumn("focal_weight", F.col("weight") / F.sum("weight").over(every) * classes)


def confidence_filters() -> dict[str, Column]:
    """The 16 filters over agreement, confirmation and direction: name -> condition; a row may pass several. Fixed values."""
    a, c, directional = F.col("agreement"), F.col("confirmation"), F.col("pred").isin(0, 2)
    full = a == 1.0
    return {
        "all_samples": F.lit(True),
        "agreement=1.0": full,
        "agreement>=0.667": a >= 0.667,
        "agreement<1.0": a < 1.0,
        "confirm>0.50": c > 0.50,
        "confirm>0.55": c > 0.55,
        "confirm>0.60": c > 0.60,
        "confirm>0.65": c > 0.65,
        "confirm>0.70": c > 0.70,
        "confirm>0.75": c > 0.75,
        "agree=1.0 AND confirm>0.60": full & (c > 0.60),
        "agree=1.0 AND confirm>0.65": full & (c > 0.65),
        "agree=1.0 AND confirm>0.70": full & (c > 0.70),
        "agree=1.0 AND confirm>0.75": full & (c > 0.75),
        "directional AND agree=1.0": directional & full,
        "directional AND agree=1.0 AND confirm>0.70": directional & full & (c > 0.70),
    }


def spread_buckets(tick: float = 0.01, price: float = 100.0) -> dict[str, Column]:
    """The three buckets of the spread in basis points, in ticks of ``tick`` at ``price``."""
    one, s = tick / price * 1e4, F.col("spread")
    return {"1tick": s <= 1.05 * one, "2tick": (s > 1.05 * one) & (s <= 2.05 * one), "wide": s > 2.05 * one}


def spread_filters(tick: float = 0.01, price: float = 100.0) -> dict[str, Column]:
    """The 13 filters over spread, agreement and confirmation. Fixed values."""
    bucket = spread_buckets(tick, price)
    one, two, wide = bucket["1tick"], bucket["2tick"], bucket["wide"]
    full, directional = F.col("agreement") == 1.0, F.col("pred").isin(0, 2)
    sure = full & (F.col("confirmation") > 0.65)
    return {
        "all_samples": F.lit(True),
        "spread=1tick": one,
        "spread=2tick": two,
        "spread=wide": wide,
        "agree=1.0": full,
        "agree=1.0 + spread=1tick": full & one,
        "agree=1.0 + spread=2tick": full & two,
        "high_conf": sure,
        "high_conf + spread=1tick": sure & one,
        "high_conf + spread=2tick": sure & two,
        "FULL_READABILITY: high_conf+1tick+dir": sure & one & directional,
        "disagree (<1.0)": ~full,
        "disagree + spread=1tick": ~full & one,
    }


def spread_distribution(rows: DataFrame, tick: float = 0.01, price: float = 100.0) -> DataFrame:
    """(n, p10 ... p99, n_1tick, share_1tick, ...): quantiles of the spread and the buckets' sizes and shares, one row."""
    levels = (10, 25, 50, 75, 90, 95, 99)
    buckets, rows = spread_buckets(tick, price), materialize(rows.select("spread"), "spreads")
    got = rows.agg(
        F.count("spread").alias("n"),
        *[x for name, c in buckets.items() for x in (count_if(c).alias(f"n_{name}"), share(c).alias(f"share_{name}"))],
    )
    return with_quantiles(got, exact_quantiles(rows, "spread", [p / 100 for p in levels], []), [], [f"p{p}" for p in levels])


def readable(agreement: float = 1.0, confirmation: float = 0.65, spread: float = 1.05) -> Column:
    """Rows that are sure enough to act on."""
    return (F.col("agreement") >= agreement) & (F.col("confirmation") > confirmation) & (F.col("spread") <= spread) & F.col("pred").isin(0, 2)


def conditioned_metrics(rows: DataFrame, filters: dict[str, Column], horizons: dict[int, tuple[str, str]] | None = None) -> DataFrame:
    """(filter, n, rate, accuracy, directional_accuracy, n_directional, precision_c, recall_c, support_c, predicted_c for the
    classes c, h<horizon>_accuracy): one scan, a row counts in each filter it passes.

    Directional rows have a label and a prediction among the outer classes. ``horizons``: horizon -> columns of its label
    and prediction. The first filter passes every row; 0 where a filter passes none.
    """
    label, pred = F.col("label"), F.col("pred")
    both = _outer(label) & _outer(pred)
    passed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in filters.items()]), lambda x: x.isNotNull())
    sides = [c for pair in (horizons or {}).values() for c in pair]
    each = rows.select("label", "pred", *dict.fromkeys(sides), F.explode(passed).alias("filter"))
    classes = []
    for c in range(3):
        hit = count_if((label == c) & (pred == c))
        classes += [ratio(hit, count_if(pred == c)).alias(f"precision_{c}"), ratio(hit, count_if(label == c)).alias(f"recall_{c}"), count_if(label == c).alias(f"support_{c}"), count_if(pred == c).alias(f"predicted_{c}")]
    got = each.groupBy("filter").agg(
        F.count(F.lit(1)).alias("n"),
        accuracy(label, pred).alias("accuracy"),
        ratio(count_if(both & (label == pred)), count_if(both)).alias("directional_accuracy"),
        count_if(both).alias("n_directional"),
        *classes,
        *[accuracy(F.col(l), F.col(p)).alias(f"h{h}_accuracy") for h, (l, p) in (horizons or {}).items()],
    )
    names = rows.sparkSession.createDataFrame([(n,) for n in filters], "filter string")
    # The first filter counts every row, so the rate needs no second scan; one row per filter.
    got = names.join(got, "filter", "left").na.fill(0)
    return got.withColumn("rate", ratio(F.col("n"), F.max("n").over(Window.partitionBy())))


def weighted_epochs(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Mean of batch values weighted by batch size."""
    return rows.groupBy(by).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(f"mean_{value}"), F.sum(weight).alias("n"))


def prediction_distribution(rows: DataFrame) -> DataFrame:
    """Shares of predicted classes, of directional and of fully agreed rows, and quantiles of confirmation."""
    rows = materialize(rows.select("pred", "agreement", "confirmation"), "predictions")
    got = rows.agg(
        *[count_if(F.col("pred") == c).alias(f"n_pred_{c}") for c in range(3)],
        share(F.col("pred") != 1).alias("directional_rate"),
        count_if(F.col("agreement") > 0.99).alias("n_full_agreement"),
        F.avg("agreement").alias("mean_agreement"),
        F.avg("confirmation").alias("mean_confirmation"),
    )
    return with_quantiles(got, exact_quantiles(rows, "confirmation", [0.25, 0.5, 0.75, 0.99], []), [], [f"confirmation_p{p}" for p in (25, 50, 75, 99)])


def horizon_accuracy(rows: DataFrame, horizons: list[int], label: str = "label_h{}", pred: str = "pred_h{}") -> DataFrame:
    """(horizon, accuracy, n) from one column pair per horizon."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(label.format(h)).alias("l"), F.col(pred.format(h)).alias("p")) for h in horizons]))
    each = rows.select(pairs.alias("x")).select("x.*").where(F.col("l").isNotNull())
    return each.groupBy("horizon").agg(accuracy(F.col("l"), F.col("p")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def mean_probabilities(rows: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """(class, mean_probability, label_share): mean probability of each class and its share of the labels."""
    each = rows.select(F.posexplode(probs).alias("class", "p"), label)
    return each.groupBy("class").agg(F.avg("p").alias("mean_probability"), share(F.col(label) == F.col("class")).alias("label_share"))
