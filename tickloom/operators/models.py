"""Models and losses: MLlib fits on vectors assembled from columns; losses and inference are row expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax, finite, softmax
from ..sources.shared import materialize
from ..sources.ticks import windowed
from .classification import class_weights
from .evaluate import class_prior, previous_label


def assemble(rows: DataFrame, features: list[str], out: str = "vector") -> DataFrame:
    """Adds a vector of ``features``; rows with a value that is not finite are dropped, as at fitting."""
    ok = F.lit(True)
    for f in features:
        ok = ok & finite(F.col(f).cast("double"))
    return VectorAssembler(inputCols=features, outputCol=out).transform(rows.where(ok))


def require_finite_for_scoring(rows: DataFrame, features: list[str]) -> DataFrame:
    """Scoring doesn't drop rows: a value that is not finite fails the job."""
    ok = F.lit(True)
    for f in features:
        ok = ok & finite(F.col(f).cast("double"))
    return rows.where(F.assert_true(ok, F.lit("features to score are not finite")).isNull())


def fit_ridge(rows: DataFrame, features: list[str], label: str, alpha: float = 1.0):
    """Ridge of penalty ``alpha`` (sum of squares form): MLlib scales the label, so its parameter is alpha / n x its deviation."""
    from pyspark.ml.regression import LinearRegression

    data = assemble(rows, features)
    s = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    return LinearRegression(featuresCol="vector", labelCol=label, solver="normal", elasticNetParam=0.0, regParam=alpha / s.n * s.s, standardization=False).fit(data)


def fit_logistic(rows: DataFrame, features: list[str], label: str, classes: int, c: float = 1.0, most_iterations: int = 100):
    """Standardized features, balanced class weights, L2 of inverse strength ``c``. Returns (scaler, model).

    The columns are written first, as each of the passes before the iterations reads them.
    """
    data = assemble(materialize(rows.select(label, *features), "rows-to-fit"), features)
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True).fit(data)
    weights = class_weights(data, classes, label).select(F.col("label").alias("_l"), F.col("weight").alias("_weight"))
    data = scaler.transform(data).join(F.broadcast(weights), F.col(label).cast("int") == F.col("_l"))
    from pyspark.ml.classification import LogisticRegression

    total = data.agg(F.sum("_weight")).first()[0]
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="_weight", regParam=1 / (c * total), standardization=False, maxIter=most_iterations).fit(data)
    return scaler, model


def logistic_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """Mean size of a feature's coefficients over the classes."""
    matrix = model.coefficientMatrix.toArray()
    return sorted(zip(features, abs(matrix).mean(0).tolist()), key=lambda x: (-x[1], x[0]))


def feature_sweep(rows: DataFrame, sets: dict[str, list[str]], classes: int, label: str = "label", split: str = "split", fit: str = "train", c: float = 1.0) -> DataFrame:
    """(name, split, accuracy, n): the class prior and a logistic model of each named set of features, both taken from the split ``fit``,
    and the previous label, measured on each split. Rows with a feature that is not finite are left out of that set's model."""
    # Written once: models, their passes and every measure read them.
    used = dict.fromkeys(f for features in sets.values() for f in features)
    rows = materialize(rows.select("day", "seq", split, label, *[f for f in used if f not in ("day", "seq", split, label)]), "rows-to-sweep")
    own = rows.where(F.col(split) == fit)
    found = {
        "class_prior": rows.join(F.broadcast(class_prior(own, label).select(F.col("majority").alias("_pred")))),
        "previous_label": windowed(rows, {"_pred": previous_label(label)}, before=1),
    }
    for name, features in sets.items():
        scaler, model = fit_logistic(own, features, label, classes, c)
        found[f"logistic_{name}"] = model.transform(scaler.transform(assemble(rows, features))).withColumnRenamed("prediction", "_pred")
    hit = F.avg((F.col("_pred") == F.col(label)).cast("double")).alias("accuracy")
    return reduce(DataFrame.unionByName, [df.groupBy(F.lit(name).alias("name"), split).agg(hit, F.count(F.lit(1)).alias("n")) for name, df in found.items()])


def fit_boosting(rows: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 5, step: float = 0.05, share: float = 0.8, leaf: int = 50, seed: int = 42):
    """Gradient-boosted trees with squared loss (MLlib has no Huber loss)."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="vector", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=share, minInstancesPerNode=leaf, seed=seed).fit(assemble(rows, features))


def score_with(rows: DataFrame, predict, columns: list[str], out: str = "yhat") -> DataFrame:
    """Adds ``out`` by a callable on Arrow-backed pandas frames of ``columns``: the boundary to outside models."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            held = (batch,) if isinstance(batch, pd.Series) else batch  # a single column comes by itself
            yield pd.Series(predict(pd.concat(held, axis=1, keys=columns)))

    return rows.withColumn(out, run(*[F.col(c) for c in columns]))


# Losses -----------------------------------------------------------------------------------------------------------


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.ln(F.greatest(F.get(softmax(logits), label.cast("int")), F.lit(1e-300)))


def focal_loss(logits: Column, label: Column, gamma: float = 2.0, alpha: list[float] | None = None) -> Column:
    """(1 - p)^gamma x cross entropy x alpha of the class."""
    p = F.get(softmax(logits), label.cast("int"))
    weight = F.lit(1.0) if alpha is None else F.get(F.array(*[F.lit(float(a)) for a in alpha]), label.cast("int"))
    return F.pow(1 - p, F.lit(gamma)) * cross_entropy(logits, label) * weight


def binary_focal_loss(p: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    own = F.when(label == 1, q).otherwise(1 - q)
    weight = F.when(label == 1, alpha).otherwise(1 - alpha)
    return -weight * F.pow(1 - own, F.lit(gamma)) * F.ln(own)


def weighted_mean(loss: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(loss * weight), F.sum(weight))


def infer(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds probs, pred and confidence (the largest probability); agreement of a single horizon is 1."""
    return rows.withColumn("probs", softmax(F.col(logits))).withColumn("pred", argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs")).withColumn("agreement", F.lit(1.0))


#: Kinds of model and the task they are trained for.
STRATEGIES = {"hmhp": "hmhp_classification", "hmhp_regression": "hmhp_regression", "regression": "regression", "classification": "classification"}


def strategy_of(model: str, loss: str, task: str) -> str:
    """How a model is trained and scored; pinball loss is not offered."""
    if loss == "pinball":
        raise ValueError("pinball loss is not offered")
    key = model if model in ("hmhp", "hmhp_regression") else ("regression" if task == "regression" else "classification")
    return STRATEGIES[key]
