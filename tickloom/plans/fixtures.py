"""The relations that the named queries run on, in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import round6
from ..operators.labels import classify, point_return
from ..sources.ticks import by_day, table, ticks, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HORIZON, THRESHOLD = 10, 8.0


def finish(df: DataFrame) -> DataFrame:
    """Output form: doubles rounded to six places, days as text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round6(c)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return add


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks and y, the point return at horizon 10; the last rows of a day have none."""
    return windowed(ticks(spark, sf_dir), {"y": point_return(HORIZON)}, after=HORIZON)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with classes 0, 1, 2, the previous label as prediction, the negative previous return as forecast."""
    # Rows without a label end the day, so that the row before a labelled one is labelled too.
    label = (classify(F.col("y"), THRESHOLD) + 1).cast("int")
    before = {"pred": F.coalesce(F.lag("label").over(by_day()), F.col("label")), "yhat": F.coalesce(-F.lag("y").over(by_day()), F.lit(0.0))}
    rows = windowed(ticks(spark, sf_dir), {"y": point_return(HORIZON)}, {"label": label}, before, before=1, after=HORIZON)
    return rows.where(F.col("y").isNotNull()).select(
        "*",
        ((F.col("k") % 3) / 2.0).alias("agreement"),
        (F.col("k") / 100.0).alias("confirmation"),
        (F.col("value") - 3 * F.floor(F.col("value") / 3)).alias("spread"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors: 0-39 a grouped book, 40-63 single features."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as experiment records."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("model"), F.col("p_type").alias("strategy"), F.split("p_name", " ").alias("tags"), (F.col("p_size") / 50.0).alias("accuracy"), (F.col("p_retailprice") / 2500.0).alias("f1"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as epochs: one run per event type, mean values as losses."""
    t = ticks(spark, sf_dir)
    per_day = t.groupBy(F.col("event_type").alias("run"), "day").agg(F.avg("value").alias("loss"), (F.avg("k") / 100.0).alias("accuracy"), F.avg(F.when(F.col("seq") % 2 == 0, F.col("value"))).alias("train_loss"), F.avg(F.when(F.col("seq") % 2 == 1, F.col("value"))).alias("val_loss"))
    first = t.agg(F.min("day").alias("_first"))
    return per_day.join(F.broadcast(first)).withColumn("epoch", F.datediff("day", "_first")).drop("_first", "day").where(F.col("val_loss").isNotNull() & F.col("train_loss").isNotNull())


W = "WINDOW w AS (PARTITION BY day ORDER BY seq)"
TICKS = """ticks AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS seq,
         event_id, user_id, event_type, ts, value, 100 + value / 100 AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
LABELED = TICKS + f""",
labeled AS (SELECT *, (lead(price, 10) OVER w - price) / price * 1e4 AS y FROM ticks {W})"""
SCORED = LABELED + f""",
classed AS (SELECT *, CASE WHEN y > 8 THEN 2 WHEN y < -8 THEN 0 ELSE 1 END AS label FROM labeled WHERE y IS NOT NULL),
scored AS (
  SELECT *, coalesce(lag(label) OVER w, label) AS pred, coalesce(-lag(y) OVER w, 0.0) AS yhat,
         (k % 3) / 2.0 AS agreement, k / 100.0 AS confirmation, value - 3 * floor(value / 3) AS spread FROM classed {W})"""
VECTORS = """cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
EXPERIMENTS = """experiments AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS model, p_type AS strategy, string_split(p_name, ' ') AS tags, p_size / 50.0 AS accuracy, p_retailprice / 2500.0 AS f1 FROM part)"""
EPOCHS = TICKS + """,
epochs AS (
  SELECT event_type AS run, date_diff('day', (SELECT min(CAST(day AS DATE)) FROM ticks), CAST(day AS DATE)) AS epoch, avg(value) AS loss, avg(k) / 100.0 AS accuracy,
         avg(CASE WHEN seq % 2 = 0 THEN value END) AS train_loss, avg(CASE WHEN seq % 2 = 1 THEN value END) AS val_loss
  FROM ticks GROUP BY event_type, day HAVING avg(CASE WHEN seq % 2 = 0 THEN value END) IS NOT NULL AND avg(CASE WHEN seq % 2 = 1 THEN value END) IS NOT NULL)"""


def r(expression: str, name: str) -> str:
    """A double rounded as ``finish`` rounds it."""
    return f"round({expression}, 6) + 0.0 AS {name}"


def ratio_sql(a: str, b: str, default: str = "0.0") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {default} END"
