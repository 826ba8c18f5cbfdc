"""Model checkpoints with a contract: what a model was fitted on is saved beside it and checked when it is loaded."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import require_finite_for_scoring

FORMAT = 1


class CheckpointError(ValueError):
    """A checkpoint is not what is asked for."""


@dataclass
class Contract:
    """What a checkpoint promises: the features in their order, the label and what the configuration's fingerprint is."""

    features: list[str]
    label: str
    task: str
    fingerprint: str
    classes: int | None = None
    types: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    format: int = FORMAT

    @property
    def digest(self) -> str:
        """Of all but the metrics."""
        body = {k: v for k, v in asdict(self).items() if k != "metrics"}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def contract_of(rows: DataFrame, features: list[str], label: str, task: str, fingerprint: str, classes: int | None = None, metrics: dict[str, float] | None = None) -> Contract:
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task {task}")
    types = {c: rows.schema[c].dataType.simpleString() for c in features}
    return Contract(list(features), label, task, fingerprint, classes, types, metrics or {})


def save_checkpoint(stages: list, contract: Contract, path: str, spark: SparkSession) -> None:
    """Save fitted ``stages`` (from the column ``vector`` on) and their contract; an earlier one of that path is replaced.

    The contract is written last, so a checkpoint without one is not complete.
    """
    body = asdict(contract) | {"digest": contract.digest}
    PipelineModel(stages).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "contract string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def read_contract(spark: SparkSession, path: str) -> Contract:
    try:
        found = spark.read.text(f"{path}/contract").collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = []
    if len(found) != 1:
        raise CheckpointError(f"{path} holds no complete checkpoint")
    body = json.loads(found[0][0])
    digest = body.pop("digest", None)
    if body.get("format") != FORMAT:
        raise CheckpointError(f"{path} has format {body.get('format')}, not {FORMAT}")
    contract = Contract(**body)
    if contract.digest != digest:
        raise CheckpointError(f"the contract of {path} was changed")
    return contract


def load_checkpoint(spark: SparkSession, path: str, fingerprint: str | None = None, features: list[str] | None = None, task: str | None = None) -> tuple[PipelineModel, Contract]:
    """The model and its contract; raises a ``CheckpointError`` that names what differs from what is asked for."""
    contract = read_contract(spark, path)
    asked = {"fingerprint": fingerprint, "features": features, "task": task}
    differs = [f"{k} {getattr(contract, k)!r} is not {v!r}" for k, v in asked.items() if v is not None and getattr(contract, k) != (list(v) if k == "features" else v)]
    if differs:
        raise CheckpointError("; ".join(differs))
    return PipelineModel.load(f"{path}/model"), contract


def score(rows: DataFrame, model: PipelineModel, contract: Contract) -> DataFrame:
    """``rows`` with yhat (regression), or pred, probs (one per class) and confidence (classification).

    Raises if a feature is missing or of another type than at fitting; a value that is not finite fails the job.
    """
    from pyspark.ml.feature import VectorAssembler

    for c, kind in contract.types.items():
        if c not in rows.columns:
            raise CheckpointError(f"feature {c} is missing")
        if rows.schema[c].dataType.simpleString() != kind:
            raise CheckpointError(f"feature {c} is {rows.schema[c].dataType.simpleString()}, not {kind}")
    kept = rows.columns
    out = model.transform(VectorAssembler(inputCols=contract.features, outputCol="vector").transform(require_finite_for_scoring(rows, contract.features)))
    if contract.task == "regression":
        return out.select(*kept, F.col("prediction").alias("yhat"))
    probs = vector_to_array("probability")
    return out.select(*kept, F.col("prediction").cast("int").alias("pred"), probs.alias("probs"), F.array_max(probs).alias("confidence"))


def calibration(scored: DataFrame, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy): how often predictions of about one confidence are right."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("pred") == F.col(label)).cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, n): the mean gap between confidence and accuracy over bins, by their rows. A row per bin comes in."""
    total = F.sum("n")
    return bins.agg((F.sum(F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")) / total).alias("ece"), total.alias("n"))


def classifier_metadata(scored: DataFrame, label: str, model: str, experiment: str) -> DataFrame:
    """(json): metrics and calibration of a scored table of a classifier, with a fingerprint of the record."""
    from .classification import accuracy

    counts = [F.count(F.when(F.col("pred") == c, 1)).alias(f"n_pred_{c}") for c in range(3)]
    ece = expected_calibration_error(calibration(scored, label)).select("ece")
    got = scored.agg(F.count(F.lit(1)).alias("n"), F.round(accuracy(F.col(label), F.col("pred")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), *counts)
    got = got.join(ece.select(F.round("ece", 6).alias("ece")))  # one row each
    body = F.struct(F.lit(model).alias("model_type"), F.lit(experiment).alias("experiment_id"), *got.columns)
    return got.select(body.alias("b")).select(F.to_json(F.struct("b.*", F.sha2(F.to_json("b"), 256).alias("fingerprint"))).alias("json"))
