"""The named queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation_queries, feature_queries, label_queries, metric_queries  # noqa: F401  they register their queries
from .fixtures import QUERIES, SCORED, SQL, finish, query, r, scored
from .metric_queries import REPORT


@query(f"WITH {SCORED}, {REPORT} SELECT label, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, support, predicted, (SELECT {r('avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)', 'x')} FROM scored) AS accuracy FROM f")
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks, point-return labels, the previous label as forecast, and the classification report."""
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.classification import accuracy, class_report

    rows = scored(spark, sf_dir)
    whole = rows.agg(accuracy(F.col("label"), F.col("pred")).alias("accuracy"))
    return finish(class_report(rows, 3).join(F.broadcast(whole)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
