"""The audit of an export, taken in the pass that writes it: metrics are observed while rows go by, and held against the
manifest and the rules afterwards. Nothing is read back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite
from .validate import ContractError

SPLITS = ("train", "val", "test")
#: Columns of a full layout with few values, by place: the values allowed (None: any from 0 up). Fixed values.
CATEGORICAL = {92: (0.0, 1.0), 93: (0.0, 1.0, 2.0, 3.0, 4.0), 94: (0.0, 1.0), 96: None}
#: Rules that only warn.
WARNINGS = ("days of the manifest", "values of feature")


def observed(width: int, categorical: dict[int, tuple[float, ...] | None]) -> dict[str, Column]:
    """The metrics of rows (split, day, features, labels), all of them partial aggregates; days are one text each."""
    every = F.col("features")
    equal = lambda v: lambda x: x == v
    found: dict[str, Column] = {}
    for s in SPLITS:
        own = F.col("split") == s
        found |= {
            f"{s}_rows": count_if(own),
            f"{s}_first": F.min(F.when(own, F.col("day").cast("string"))),
            f"{s}_last": F.max(F.when(own, F.col("day").cast("string"))),
            f"{s}_days": F.collect_set(F.when(own, F.col("day").cast("string"))),
            f"{s}_not_finite": F.coalesce(F.sum(F.when(own, F.size(F.filter(every, lambda x: ~finite(x))))), F.lit(0)),
            f"{s}_unlabelled": count_if(own & (F.coalesce(F.size("labels"), F.lit(0)) <= 0)),
            **{f"{s}_label_{name}": F.coalesce(F.sum(F.when(own, F.size(F.filter("labels", equal(v))))), F.lit(0)) for name, v in (("down", -1), ("stable", 0), ("up", 1))},
            f"{s}_label_other": F.coalesce(F.sum(F.when(own, F.size(F.filter("labels", lambda x: x.isNull() | ~x.isin(-1, 0, 1))))), F.lit(0)),
        }
    found["other_splits"] = count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))
    found["other_widths"] = count_if(F.coalesce(F.size(every), F.lit(-1)) != width)
    for i, allowed in categorical.items():
        x = F.get(every, F.lit(i))
        found[f"feature_{i}"] = count_if(finite(x) & ((x < 0) if allowed is None else ~x.isin(*allowed)))
    return found


def judged(seen: dict, width: int, categorical: dict[int, tuple[float, ...] | None], manifest: dict | None) -> list[tuple[str, str, bool]]:
    """(rule, found, ok) of the observed metrics."""
    out = []
    for s in SPLITS:
        out.append((f"{s} rows", str(seen[f"{s}_rows"]), seen[f"{s}_rows"] > 0))
        out.append((f"{s} values that are not finite", str(seen[f"{s}_not_finite"]), seen[f"{s}_not_finite"] == 0))
        out.append((f"{s} rows without labels", str(seen[f"{s}_unlabelled"]), seen[f"{s}_unlabelled"] == 0))
        labels = {k: seen[f"{s}_label_{k}"] for k in ("down", "stable", "up", "other")}
        # Each of the three is expected to occur, and nothing else.
        out.append((f"{s} labels", ", ".join(f"{k} {n}" for k, n in labels.items()), labels["other"] == 0 and all(labels[k] for k in ("down", "stable", "up"))))
    spans = [(seen[f"{s}_first"], seen[f"{s}_last"]) for s in SPLITS]
    ordered = all(a[1] is not None and b[0] is not None and a[1] < b[0] for a, b in zip(spans, spans[1:]))
    out.append(("order of splits", "; ".join(f"{s} {a} to {b}" for s, (a, b) in zip(SPLITS, spans)), ordered))
    out.append(("rows of other splits", str(seen["other_splits"]), seen["other_splits"] == 0))
    out.append((f"rows without {width} features", str(seen["other_widths"]), seen["other_widths"] == 0))
    for i, allowed in categorical.items():
        text = "values of feature" if allowed is not None else "negative values in feature"
        out.append((f"{text} {i}", str(seen[f"feature_{i}"]), seen[f"feature_{i}"] == 0))
    if manifest is not None:
        days = sum(len(seen[f"{s}_days"]) for s in SPLITS)
        out.append(("features of the manifest", str(manifest.get("feature_count")), manifest.get("feature_count") == width))
        out.append(("days of the manifest", f"{manifest.get('days_processed')}, written {days}", manifest.get("days_processed") == days))
        if "total_rows" in manifest:
            rows = sum(seen[f"{s}_rows"] for s in SPLITS)
            out.append(("rows of the manifest", f"{manifest['total_rows']}, written {rows}", manifest["total_rows"] == rows))
    return out


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an export (JSON), None if there is none."""
    found = spark.read.option("pathGlobFilter", "dataset_manifest.json").text(path, wholetext=True).limit(1).collect()
    return json.loads(found[0][0]) if found else None


def write_audited(rows: DataFrame, path: str, width: int, categorical: dict[int, tuple[float, ...] | None] | None = None, manifest: dict | None = None, require: bool = False) -> DataFrame:
    """Write ``rows`` (split, day, features, labels: array, ...) by split and day; returns (rule, found, ok, level) of its audit.

    ``level`` is error or warning. ``require``: a ``ContractError`` names the broken rules that are errors. A task that runs
    again is observed once: metrics are those of the successful tasks.
    """
    categorical = {i: v for i, v in CATEGORICAL.items() if i < width} if categorical is None else categorical
    watch = Observation("export audit")
    seen_rows = rows.observe(watch, *[c.alias(k) for k, c in observed(width, categorical).items()])
    seen_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "day").parquet(path)
    found = [(rule, text, ok, "warning" if rule.startswith(WARNINGS) else "error") for rule, text, ok in judged(watch.get, width, categorical, manifest)]
    broken = [f"{rule}: {text}" for rule, text, ok, level in found if not ok and level == "error"]
    if require and broken:
        raise ContractError("; ".join(broken))
    return rows.sparkSession.createDataFrame(found, "rule string, found string, ok boolean, level string")
