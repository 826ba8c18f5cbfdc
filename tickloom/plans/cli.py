"""Command line: run named queries, fit and evaluate a configured experiment, audit an export.

    python -m tickloom.plans.cli list
    python -m tickloom.plans.cli run q_class_report --data DIR [--out PATH]
    python -m tickloom.plans.cli train CONFIG --data DIR [--set train.epochs=3] [--out PATH]
    python -m tickloom.plans.cli export CONFIG --data DIR --out PATH [--set model.kind=ridge]
    python -m tickloom.plans.cli validate --data DIR
    python -m tickloom.plans.cli audit --export DIR --schema 2.2
    python -m tickloom.plans.cli stats --export DIR --split train --out DIR
    python -m tickloom.plans.cli ci --signals DIR --split test --out DIR [--replicates 10000] [--rerank]
    python -m tickloom.plans.cli pairwise --signals NAME=DIR NAME=DIR ... --split test --out DIR [--metric ic]

``stats``, ``ci`` and ``pairwise`` keep their results under --out and read them again as long as rows and parameters are
the same.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..operators import artifacts
from ..sources.day_files import day_files
from ..sources.shared import materialize
from ..sources.ticks import numbered, read_split, windowed, with_split, write_signals
from . import catalog, config
from .fixtures import finish, scored

COLUMNS = ["value", "spread", "k"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    train, export = sub.add_parser("train"), sub.add_parser("export")
    for s in (train, export):
        s.add_argument("config")
        s.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    validate = sub.add_parser("validate")
    for s in (run, train, export, validate):
        s.add_argument("--data", required=True)
        s.add_argument("--out", required=s is export)
    audit, stats, ci, pairwise = (sub.add_parser(n) for n in ("audit", "stats", "ci", "pairwise"))
    for s in (audit, stats):
        s.add_argument("--export", required=True)
    audit.add_argument("--schema", required=True)
    audit.add_argument("--source", default="auto", choices=("auto", "precomputed", "forward_prices"))
    ci.add_argument("--signals", required=True)
    pairwise.add_argument("--signals", required=True, nargs="+", metavar="NAME=DIR")
    pairwise.add_argument("--metric", default="ic")
    for s in (stats, ci, pairwise):
        s.add_argument("--split", default="train" if s is stats else "test")
        s.add_argument("--out", required=True)
    for s in (ci, pairwise):
        s.add_argument("--replicates", type=int, default=10_000)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--block", type=int)
        s.add_argument("--rerank", action="store_true")
    return p


def overrides(pairs: list[str]) -> dict:
    """NAME=VALUE pairs; values are JSON where they parse, else text."""
    out = {}
    for pair in pairs:
        name, sep, value = pair.partition("=")
        if not sep:
            raise config.ConfigError(f"{pair!r} is not NAME=VALUE")
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
        if isinstance(out[name], list):
            out[name] = tuple(out[name])
    return out


def regressed(rows: DataFrame, experiment: config.Experiment) -> DataFrame:
    """``rows`` with yhat, of the configured regression model fitted on the training days; rows it cannot score are left out."""
    from ..operators import boosting, models

    fit, kind = rows.where("split = 'train'"), experiment.model.kind
    if kind not in ("ridge", "boosting"):
        raise config.ConfigError(f"a {kind} model gives no forecasts")
    rows = rows.drop("yhat")
    if kind == "boosting":
        model = boosting.fit_huber_trees(fit, COLUMNS, "y", trees=experiment.model.trees, seed=experiment.train.seed)
        return boosting.score_trees(rows, model).where("yhat IS NOT NULL")
    model = models.fit_ridge(fit, COLUMNS, "y", experiment.model.alpha)
    return model.transform(models.assemble(rows, COLUMNS)).withColumnRenamed("prediction", "yhat").drop("vector")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(scored(spark, sf_dir)).withColumn("k", F.col("k").cast("double"))


def train(spark: SparkSession, experiment: config.Experiment, sf_dir: str) -> DataFrame:
    """(split, model metrics) of the configured model: fitted on the training days, measured on each split."""
    from ..operators import classification, evaluate, models, regression

    rows, kind = split_rows(spark, sf_dir), experiment.model.kind
    fit = rows.where("split = 'train'")
    if kind in ("ridge", "boosting"):
        return regression.regression_metrics(regressed(rows, experiment), ["split"])
    if kind == "logistic":
        scaler, model = models.fit_logistic(fit, COLUMNS, "label", experiment.model.classes)
        out = model.transform(scaler.transform(models.assemble(rows, COLUMNS))).withColumn("pred", F.col("prediction").cast("int"))
    elif kind == "class_prior":
        out = rows.drop("pred").join(F.broadcast(evaluate.class_prior(fit).select(F.col("majority").alias("pred"))))
    else:
        out = windowed(rows, {"pred": evaluate.previous_label()}, before=1)
    return out.groupBy("split").agg(classification.accuracy(F.col("label"), F.col("pred")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def export_signals(spark: SparkSession, experiment: config.Experiment, sf_dir: str, path: str) -> DataFrame:
    """Write the model's signals by split and day; returns their metadata record."""
    from ..operators import evaluate

    rows = regressed(split_rows(spark, sf_dir), experiment).select("split", "day", "seq", "price", "spread", "y", "yhat")
    write_signals(rows, path)
    return evaluate.signal_metadata(spark.read.schema(rows.schema).parquet(path), experiment.model.kind, experiment.name)


def audited(spark: SparkSession, export: str, schema: str, source: str) -> DataFrame:
    """(split, day, problem) of an export of day files, by headers, metadata and values; empty for a sound one."""
    from ..operators import load

    days = load.day_sources(load.day_headers(spark, export), load.day_metadata(spark, export).withColumnRenamed("n_features", "meta_features"), source)
    rows = day_files(spark, export, ["split", "day", "seq", "features", "labels", "regression_labels"])
    return load.day_problems(days, schema).unionByName(load.row_problems(rows, labelled=True))


def signals(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(day, seq, y, yhat) of a signal export, the rows where both are finite."""
    rows = read_split(spark, path, split).select("day", "seq", "y", "yhat")
    return rows.where(finite(F.col("y")) & finite(F.col("yhat")))


def kept_result(spark: SparkSession, args: argparse.Namespace) -> artifacts.Artifact:
    """The result of stats, ci or pairwise, read or computed."""
    if args.command == "stats":
        return artifacts.stats_artifact(day_files(spark, args.export, ["split", "day", "seq", "features"]).where(F.col("split") == args.split), args.out)
    if args.command == "ci":
        rows = materialize(numbered(signals(spark, args.signals, args.split)), "numbered")
        return artifacts.ci_artifact(rows, args.out, "y", "yhat", args.replicates, args.seed, length=args.block, rerank=args.rerank)
    named = dict(pair.split("=", 1) for pair in args.signals)
    if len(named) < 2:
        raise config.ConfigError("a comparison needs two or more signals NAME=DIR of different names")
    rows = None
    for name, path in sorted(named.items()):
        own = signals(spark, path, args.split).withColumnRenamed("yhat", name)
        # Treatments are paired by the tick; a tick whose labels differ, or that one of them lacks, is no pair.
        rows = own if rows is None else rows.join(own, ["day", "seq", "y"])
    rows = materialize(numbered(rows), "numbered")
    return artifacts.pairwise_artifact(rows, args.out, "y", list(named), args.replicates, args.seed, args.block, args.metric, rerank=args.rerank)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return None
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "audit":
        out = audited(spark, args.export, args.schema, args.source)
        out.show(50, truncate=False)
        return out
    if args.command in ("stats", "ci", "pairwise"):
        held = kept_result(spark, args)
        print(f"{'read' if held.cached else 'computed'} {held.key}" + "".join(f"\n  {d}" for d in held.drift))
        held.table.show(50, truncate=False)
        return held.table
    if args.command == "run":
        out = catalog.queries()[args.name](spark, args.data)
    elif args.command in ("train", "export"):
        experiment = config.override(config.load(args.config), overrides(args.set))
        for w in experiment.warnings():
            print(f"warning: {w}")
        if args.command == "export":
            out = export_signals(spark, experiment, args.data, args.out)
            out.show(1, truncate=False)
            return out
        out = finish(train(spark, experiment, args.data)).withColumn("fingerprint", F.lit(config.fingerprint(experiment)))
    else:
        out = catalog.queries()["q_data_quality"](spark, args.data).where("n_null + n_nan + n_inf > 0")
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
