"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A temporary folder is set only in local mode, where there is one machine; on a cluster each
    executor would write to its own disk, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


#: Spark drops the shuffles of a query at its end, in place of when the driver's JVM happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back. A write has a plan of its own, so nothing else reads the shuffles it drops."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return written(df, shared_path(df.sparkSession, tag))


@contextmanager
def scratch(df: DataFrame, tag: str) -> Iterator[DataFrame]:
    """As ``materialize``, but the table is deleted at the end of the block: what is made of it has to be written within."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    try:
        yield written(df, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, heavy: int = 1000) -> DataFrame:
    """``rows`` joined (inner) with ``groups`` (written, a row per key with the number of its rows in ``size``) on ``keys``.

    Groups of more than total / heavy rows are fewer than ``heavy``: they are broadcast, and their rows don't shuffle. So a
    key with a third of all rows is no one task's work. Keys are not null.
    """
    values = [c for c in groups.columns if c not in keys]
    large = groups.where(F.col(size) > total / heavy).withColumn("_large", F.lit(True))
    marked = rows.join(F.broadcast(large), keys, "left")
    rest = marked.where("_large IS NULL").drop("_large", *values).join(groups, keys)
    return marked.where("_large").drop("_large").unionByName(rest)
