"""Results that are kept and notice drift: a table is read again as long as its rows and parameters are the same.

A result of ``name`` lies under ``<path>/<name>/<key>``, where the key is a hash of the fingerprint of the rows and of all
parameters, so one with other rows or parameters is another folder and never read in its place. It is written to a folder of
its own first and gets its name by a rename, so that a half-written one is not taken for a result. A record beside it says what it was
computed from; the latest record tells how a new call differs.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .normalize import feature_statistics
from .resample import METRICS, block_length, bootstrap_ci, paired_differences

RECORD = "key string, made double, fingerprint string, parameters string"


@dataclass
class Artifact:
    table: DataFrame
    key: str
    cached: bool
    drift: list[str] = field(default_factory=list)


def rows_fingerprint(rows: DataFrame) -> str:
    """SHA-256 of the schema, the number of rows and two sums of 64-bit hashes of all columns: the order of rows and their
    partitions don't matter, how often a row occurs does. One aggregate."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    # Nulls leave a hash as it is, so which columns are null is hashed too.
    marks = [c.isNull() for c in cols]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    got = rows.agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64(*cols, *marks)).alias("a"), total(F.xxhash64(F.lit(1), *marks, *reversed(cols))).alias("b")).first()
    return hashlib.sha256(json.dumps([rows.schema.simpleString(), got.n, got.a, got.b]).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, for any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at(f"{path}/_SUCCESS"))


def _commit(spark: SparkSession, table: DataFrame, path: str) -> None:
    own = f"{path}.{uuid.uuid4().hex[:8]}"
    table.write.parquet(own)
    fs, at = _files(spark, path)
    if fs.exists(at(path)) and not _exists(spark, path):
        fs.delete(at(path), True)  # what a failed writer without renames has left
    if not fs.rename(at(own), at(path)):
        fs.delete(at(own), True)  # another run was first, with the same key


def latest_record(spark: SparkSession, folder: str) -> dict | None:
    fs, at = _files(spark, folder)
    if not fs.exists(at(f"{folder}/records")):
        return None
    last = spark.read.schema(RECORD).json(f"{folder}/records").orderBy(F.desc("made")).first()
    return last.asDict() | {"parameters": json.loads(last.parameters)} if last else None


def differences(record: dict | None, fingerprint: str, parameters: dict) -> list[str]:
    """How ``parameters`` and rows differ from those of a record."""
    if record is None:
        return []
    old = record["parameters"]
    found = [f"{k}: {old.get(k)!r} -> {parameters.get(k)!r}" for k in sorted(old.keys() | parameters.keys()) if old.get(k) != parameters.get(k)]
    return found + (["the rows changed"] if record["fingerprint"] != fingerprint else [])


def artifact(spark: SparkSession, path: str, name: str, parameters: dict, fingerprint: str, compute: Callable[[], DataFrame]) -> Artifact:
    """The stored result of these parameters and rows, else ``compute()``'s, stored. ``parameters`` hold JSON values."""
    parameters = json.loads(json.dumps(parameters))
    key = hashlib.sha256(json.dumps([name, fingerprint, parameters], sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{path.rstrip('/')}/{name}"
    own = f"{folder}/{key}"
    if _exists(spark, own):
        return Artifact(spark.read.parquet(own), key, True)
    drift = differences(latest_record(spark, folder), fingerprint, parameters)
    if drift:
        logging.getLogger(__name__).warning("%s is computed anew: %s", name, "; ".join(drift))
    _commit(spark, compute(), own)
    record = spark.createDataFrame([(key, time.time(), fingerprint, json.dumps(parameters, sort_keys=True))], RECORD)
    record.write.mode("append").json(f"{folder}/records")
    return Artifact(spark.read.parquet(own), key, False, drift)


def ci_artifact(rows: DataFrame, path: str, y: str, p: str, replicates: int = 10_000, seed: int = 42, confidence: float = 0.95, length: int | None = None, metrics: tuple[str, ...] = METRICS, rerank: bool = False) -> Artifact:
    """Intervals of ``bootstrap_ci`` over ``rows`` (with i), kept under ``path``."""
    rows, n = rows.select("i", y, p), rows.count()
    parameters = {"y": y, "p": p, "replicates": replicates, "seed": seed, "confidence": confidence, "length": block_length(n, length), "metrics": sorted(metrics), "rerank": rerank}
    return artifact(rows.sparkSession, path, "metrics_ci", parameters, rows_fingerprint(rows), lambda: bootstrap_ci(rows, y, p, n, replicates, seed, confidence, length, metrics, rerank))


def pairwise_artifact(rows: DataFrame, path: str, y: str, treatments: list[str], replicates: int = 10_000, seed: int = 42, length: int | None = None, metric: str = "ic", alpha: float = 0.05, rerank: bool = False) -> Artifact:
    """All pairs of ``paired_differences`` over ``rows`` (with i), kept under ``path``."""
    names = sorted(treatments)
    rows, n = rows.select("i", y, *names), rows.count()
    parameters = {"y": y, "treatments": names, "replicates": replicates, "seed": seed, "length": block_length(n, length), "metric": metric, "alpha": alpha, "rerank": rerank}
    return artifact(rows.sparkSession, path, "pairwise", parameters, rows_fingerprint(rows), lambda: paired_differences(rows, y, names, n, replicates, seed, length, metric, alpha, rerank))


def stats_artifact(rows: DataFrame, path: str, features: str = "features", by: list[str] | None = None, floor: float = 1e-8) -> Artifact:
    """Feature statistics of ``rows``, kept under ``path``."""
    by = by or []
    rows = rows.select(*by, features)
    return artifact(rows.sparkSession, path, "feature_stats", {"features": features, "by": by, "floor": floor}, rows_fingerprint(rows), lambda: feature_statistics(rows, by, features, floor))
