"""Reading ordered time series: the canonical relation is keyed by (day, seq), seq from 0 within a day.

A day is not the unit of work: days are numbered by slots of the clock, and windows run over blocks of ``BLOCK`` rows of
a day, each with copies of the few rows before and after it that its frames reach (``windowed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a day in one window partition, and minutes of the clock in one slot of its numbering.
BLOCK, SLOT_MINUTES = 1 << 18, 10


def by_day() -> WindowSpec:
    """The order within a day, for use in ``windowed``; windows of all operators share this specification."""
    return Window.partitionBy("day", "_block").orderBy("seq")


def windowed(rows: DataFrame, *stages: dict[str, Column], before: int = 0, after: int = 0) -> DataFrame:
    """``rows`` with columns over ``by_day()``, one ``select`` for each of ``stages``.

    ``before`` and ``after`` are how far all frames together reach. Rows within that distance of a block's edge are copied
    into the next block, so every frame is as full as in the whole day; copies are dropped at the end.
    """
    seq = F.col("seq")
    first, last = F.greatest(F.floor((seq - after) / BLOCK), F.lit(0).cast("long")), F.floor((seq + before) / BLOCK)
    got = rows.withColumn("_block", F.explode(F.sequence(first, last)))
    for stage in stages:
        got = got.withColumns(stage)
    return got.where(F.col("_block") == F.floor(seq / BLOCK)).drop("_block")


def row_before(rows: DataFrame, value: str, out: str, by: tuple[str, ...] = ("day",)) -> DataFrame:
    """Adds ``out``: ``value`` of the row before within ``by``, in the order of seq, however far back that is; null for the first.

    Within blocks of a day by a window; the first row of a block takes the last value of the last block that has rows
    (a row per block).
    """
    placed = rows.withColumn("_own", F.floor(F.col("seq") / BLOCK))
    last = placed.groupBy(*by, "_own").agg(F.max_by(F.struct(value), "seq").alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*by).orderBy("_own"))
    last = last.select(*by, "_own", earlier.alias("_last"))
    inside = Window.partitionBy(*by, "_own").orderBy("seq")
    got = placed.withColumn("_inside", F.lag(F.struct(value)).over(inside)).join(last, [*by, "_own"])
    return got.withColumn(out, F.coalesce("_inside", "_last")[value]).drop("_own", "_inside", "_last")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds i, the place in the order of (day, seq): places within blocks of a day, and the counts of blocks and days before."""
    placed = rows.withColumn("_own", F.floor(F.col("seq") / BLOCK))
    blocks = placed.groupBy("day", "_own").agg(F.count(F.lit(1)).alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = blocks.groupBy("day").agg(F.sum("_n").alias("_n")).select("day", earlier(Window.orderBy("day")).alias("_days"))  # a row per day
    starts = blocks.select("day", "_own", earlier(Window.partitionBy("day").orderBy("_own")).alias("_blocks")).join(days, "day")
    within = F.row_number().over(Window.partitionBy("day", "_own").orderBy("seq")) - 1
    got = placed.withColumn("_within", within).join(starts, ["day", "_own"])
    return got.withColumn("i", F.col("_days") + F.col("_blocks") + F.col("_within")).drop("_own", "_within", "_days", "_blocks")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_days(rows: DataFrame, ts: str, tie: str) -> DataFrame:
    """Adds day (date of ``ts``) and seq (place within the day by ``ts``, then ``tie``).

    Rows are ordered within slots of the clock; the counts of the slots before (a row per slot and day) give the rest.
    """
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / SLOT_MINUTES)
    placed = rows.withColumn("day", F.to_date(ts)).withColumn("_slot", slot)
    counts = placed.groupBy("day", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("day").alias("_day"), F.col("_slot").alias("_at"), earlier.alias("_start"))
    within = placed.withColumn("_within", F.row_number().over(Window.partitionBy("day", "_slot").orderBy(ts, tie)) - 1)
    # A null moment is of no day and no slot.
    got = within.join(starts, F.col("day").eqNullSafe(F.col("_day")) & F.col("_slot").eqNullSafe(F.col("_at")))
    return got.withColumn("seq", (F.col("_start") + F.col("_within")).cast("long")).drop("_slot", "_day", "_at", "_start", "_within")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a tick stream: price = 100 + value / 100, k from the properties."""
    rows = number_days(table(spark, sf_dir, "events"), "ts", "event_id")
    return rows.select("day", "seq", "event_id", "user_id", "event_type", "ts", "value", (100 + F.col("value") / 100).alias("price"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def with_split(rows: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Adds split: the days in order, the first share train, then val, the rest test. Days are few: they are aggregated first."""
    days = rows.select("day").distinct().withColumn("_at", F.percent_rank().over(Window.orderBy("day")))
    name = F.when(F.col("_at") < train, "train").when(F.col("_at") < train + val, "val").otherwise("test")
    return rows.join(days.select("day", name.alias("split")), "day")


def first_days(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the first ``most`` days (a table of at most ``most`` rows is broadcast)."""
    days = rows.select("day").distinct().orderBy("day").limit(most)
    return rows.join(F.broadcast(days), "day", "left_semi")


def read_split(spark: SparkSession, path: str, split: str, day: str | None = None, schema=None) -> DataFrame:
    """A split of an export written by ``write_signals`` or alike: partitions by split and day are pruned, not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).where(F.col("split") == split)
    return rows if day is None else rows.where(F.col("day") == day)


def export_format(columns: list[str]) -> str:
    """aligned: sequences (a matrix per row); legacy: one feature vector per row."""
    if "sequence" in columns:
        return "aligned"
    if "features" in columns:
        return "legacy"
    raise ValueError("an export has a column sequence or features")


def last_step(sequence: Column | str = "sequence") -> Column:
    return F.element_at(F.col(sequence) if isinstance(sequence, str) else sequence, -1)


def price_and_spread(rows: DataFrame, features: Column, price: int = 40, spread: int = 42) -> DataFrame:
    """(day, seq, price, spread) from the last step's mid-price and spread columns, as doubles.

    ``features``: a row's sequence (its last step counts) or feature vector. The defaults are the layout's fixed places.
    """
    kind = rows.select(features.alias("x")).schema["x"].dataType.simpleString()
    step = last_step(features) if kind.startswith("array<array") else features
    return rows.select("day", "seq", F.get(step, F.lit(price)).cast("double").alias("price"), F.get(step, F.lit(spread)).cast("double").alias("spread"))


def day_profile(rows: DataFrame) -> DataFrame:
    """Rows, first and last moment and value range per day."""
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per-day metadata sidecars (JSON), only the fields that are asked of them."""
    schema = "day string, n_sequences long, window_size long, n_features long, schema_version string, contract_version string, label_strategy string, horizons array<int>, labeling struct<horizons: array<int>, label_mode: string>, label_config struct<horizons: array<int>>"
    meta = spark.read.schema(schema).option("multiLine", True).json(path)
    return meta.withColumn("horizons", F.coalesce("horizons", "labeling.horizons", "label_config.horizons")).drop("labeling", "label_config")


def write_signals(rows: DataFrame, path: str) -> None:
    """Signals partitioned by split and day; a rerun replaces only the partitions it writes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "day").parquet(path)
