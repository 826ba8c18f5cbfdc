"""Loading a split of day files: checks of every day, and the source of its labels, in one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite
from ..sources.day_files import day_files
from ..sources.shared import materialize
from .labels import BPS, classify
from .validate import ContractError

#: Place of the flag of a valid book, and of the column that must stay 0, in a full feature layout; fixed values.
BOOK_VALID, RESERVED = 92, 97
META = "schema_version string, n_features long, horizons array<int>, labeling struct<horizons: array<int>>, label_config struct<horizons: array<int>>, forward_prices struct<exported: boolean, smoothing_window_offset: int, n_columns: int>"


def day_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(split, day, schema_version, n_features, horizons, exported, k, n_columns) of the metadata files of an export."""
    name = F.col("_metadata.file_path")
    files = spark.read.schema(META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_metadata.json")
    meta = files.json(path)
    return meta.select(
        F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("split"),
        F.regexp_extract(name, r"([^/]+)_metadata\.json$", 1).alias("day"),
        "schema_version", "n_features",
        F.coalesce("horizons", "labeling.horizons", "label_config.horizons").alias("horizons"),
        F.coalesce("forward_prices.exported", F.lit(False)).alias("exported"),
        F.col("forward_prices.smoothing_window_offset").alias("k"), F.col("forward_prices.n_columns").alias("n_columns"),
    )


def day_headers(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(split, day, aligned, n_rows, n_features, <kind>_rows): shapes of each day's arrays, none of which is read."""
    heads = day_files(spark, path, headers=True)
    heads = heads if split is None else heads.where(F.col("split") == split)
    rows = lambda kind: F.max(F.when(F.col("kind") == kind, F.get("shape", F.lit(0)))).alias(f"{kind}_rows")
    data = F.col("kind").isin("sequences", "features")
    return heads.groupBy("split", "day").agg(
        (F.max(F.when(F.col("kind") == "sequences", F.size("shape"))) == 3).alias("aligned"),
        F.max(F.when(data, F.get("shape", F.lit(0)))).alias("n_rows"),
        F.max(F.when(data, F.element_at("shape", -1))).alias("n_features"),
        *[rows(kind) for kind in ("labels", "regression_labels", "forward_prices")],
    ).withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def day_sources(heads: DataFrame, meta: DataFrame, source: str = "auto") -> DataFrame:
    """``heads`` with their metadata and label_source: forward_prices, if they are asked for or (auto) are there and declared;
    else precomputed."""
    if source not in ("auto", "precomputed", "forward_prices"):
        raise ValueError(f"unknown label source {source}")
    got = heads.join(meta, ["split", "day"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)))
    there = F.col("forward_prices_rows").isNotNull() & F.col("exported")
    pick = {"auto": F.when(there, "forward_prices").otherwise("precomputed"), "precomputed": F.lit("precomputed"), "forward_prices": F.lit("forward_prices")}
    return got.withColumn("label_source", pick[source])


def day_problems(days: DataFrame, schema_version: str, horizons: list[int] | None = None) -> DataFrame:
    """(split, day, problem): the first broken rule of each day (``day_sources``) that breaks one. A row per day, no data read."""
    asked = F.lit(horizons).cast("array<int>") if horizons else F.col("horizons")
    forward = F.col("label_source") == "forward_prices"
    rules = [
        (F.col("schema_version").isNull(), F.lit("no metadata, or none with a schema version")),
        (F.col("schema_version") != schema_version, F.concat(F.lit("schema "), F.col("schema_version"), F.lit(f" is not {schema_version}"))),
        (F.col("n_rows").isNull(), F.lit("neither sequences nor features")),
        (F.coalesce("labels_rows", "regression_labels_rows", "forward_prices_rows").isNull(), F.lit("no labels of any kind")),
        (F.col("meta_features").isNotNull() & (F.col("meta_features") != F.col("n_features")), F.lit("the number of features is not the one declared")),
        (F.col("n_features") != F.col("_width"), F.lit("the number of features differs from the first day's")),
        (forward & F.col("forward_prices_rows").isNull(), F.lit("forward prices are asked for and not there")),
        (forward & ~F.col("exported"), F.lit("forward prices are asked for and not declared")),
        (forward & F.col("k").isNull(), F.lit("the offset of forward prices is not declared")),
        (forward & asked.isNull(), F.lit("no horizons")),
        (forward & (F.array_max(asked) + F.col("k") >= F.col("n_columns")), F.lit("a horizon lies beyond the forward prices")),
        (~forward & F.coalesce("labels_rows", "regression_labels_rows").isNull(), F.lit("precomputed labels are asked for and not there")),
    ] + [(F.col(f"{k}_rows") != F.col("n_rows"), F.lit(f"{k} and data differ in rows")) for k in ("labels", "regression_labels", "forward_prices")]
    problem = F.coalesce(*[F.when(broken, text) for broken, text in rules])
    first = days.groupBy("split").agg(F.min_by("n_features", "day").alias("_width"))
    return days.join(first, "split").select("split", "day", problem.alias("problem")).where("problem IS NOT NULL")


def returns_of_array(forward: Column, k: Column, h: Column, how: str = "point_return") -> Column:
    """A return in basis points from prices around t, of which the one at t has the place ``k``.

    point: price at t + h against t; smoothed: mean of [t + h - k, t + h] against mean of [t - k, t]; mean: mean of
    [t + 1, t + h] against t; peak: the return of [t + 1, t + h] of largest size, of two equal ones the rise.
    """
    at = lambda i: F.get(forward, i)
    now, ahead = at(k), F.slice(forward, k + 2, h)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v, lambda s: s / F.size(x))
    if how == "point_return":
        return (at(k + h) - now) / now * BPS
    if how == "smoothed_return":
        past = mean(F.slice(forward, F.lit(1), k + 1))
        return (mean(F.slice(forward, h + 1, k + 1)) - past) / past * BPS
    if how == "mean_return":
        return (mean(ahead) - now) / now * BPS
    if how == "peak_return":
        up, down = (F.array_max(ahead) - now) / now * BPS, (F.array_min(ahead) - now) / now * BPS
        return F.when(F.abs(up) >= F.abs(down), up).otherwise(down)
    raise ValueError(f"unknown return {how}")


def row_problems(rows: DataFrame, labelled: bool) -> DataFrame:
    """(split, day, problem) of days whose values break a rule: one aggregate per day.

    Features must be finite in rows of a valid book (all rows, if there is no such flag or no such row); labels -1, 0, 1.
    """
    has_flag = F.size("features") > BOOK_VALID
    valid = ~has_flag | (F.get("features", F.lit(BOOK_VALID)) > 0.5)
    odd = F.exists("features", lambda x: ~finite(x))
    got = rows.groupBy("split", "day").agg(
        count_if(valid).alias("_valid"), count_if(odd).alias("_odd"), count_if(odd & valid).alias("_odd_valid"),
        count_if(F.exists("labels", lambda x: ~x.isin(-1, 0, 1))).alias("_labels") if labelled else F.lit(0).alias("_labels"),
        count_if(F.exists("regression_labels", lambda x: ~finite(x))).alias("_returns"),
    )
    bad = F.when(F.col("_valid") > 0, F.col("_odd_valid")).otherwise(F.col("_odd"))
    problem = F.coalesce(
        F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" rows with features that are not finite"))),
        F.when(F.col("_labels") > 0, F.concat(F.col("_labels").cast("string"), F.lit(" rows with labels other than -1, 0, 1"))),
        F.when(F.col("_returns") > 0, F.concat(F.col("_returns").cast("string"), F.lit(" rows with returns that are not finite"))),
    )
    return got.select("split", "day", problem.alias("problem")).where("problem IS NOT NULL")


def reserved_warnings(rows: DataFrame) -> DataFrame:
    """(split, day, n): rows of a full layout whose reserved column is not 0."""
    x = F.get("features", F.lit(RESERVED))
    return rows.where(x != 0).groupBy("split", "day").agg(F.count(F.lit(1)).alias("n"))


def require_none(problems: DataFrame) -> None:
    """Raises with the first 20 days that have a problem."""
    found = problems.orderBy("split", "day").limit(20).collect()
    if found:
        raise ContractError("; ".join(f"{r.split} {r.day}: {r.problem}" for r in found))


def load_split(spark: SparkSession, path: str, split: str, schema_version: str, source: str = "auto", horizons: list[int] | None = None, returns: str = "point_return", threshold: float | None = None, validate: bool = True, columns: tuple[str, ...] = ("features",)) -> DataFrame:
    """(split, day, seq, <columns>, labels, regression_labels, label_source) of a split of an export.

    Days are checked by headers and metadata before any row is read, then (``validate``) by their values in one scan; a
    ``ContractError`` names those that break a rule. ``source``: as in ``day_sources``. Labels from forward prices are the
    ``returns`` at ``horizons`` (by default those of the metadata), and with a ``threshold`` classes -1, 0, 1 of these;
    the offset of the price at t is always the export's own. ``columns``: features (the last step), sequence, or both.
    """
    days = day_sources(day_headers(spark, path, split), day_metadata(spark, path).withColumnRenamed("n_features", "meta_features"), source)
    days = materialize(days, "days")
    if days.limit(1).count() == 0:
        raise FileNotFoundError(f"there are no days in {path}/{split}")
    require_none(day_problems(days, schema_version, horizons))
    read = day_files(spark, path, ["split", "day", "seq", *dict.fromkeys([*columns, "features"]), "labels", "regression_labels", "forward_prices"])
    rows = read.where(F.col("split") == split).join(days.select("split", "day", "label_source", "k", F.col("horizons").alias("_own")), ["split", "day"])
    asked = F.lit(horizons).cast("array<int>") if horizons else F.col("_own")
    computed = F.transform(asked, lambda h: returns_of_array(F.col("forward_prices"), F.col("k"), h, returns))
    forward = F.col("label_source") == "forward_prices"
    got = rows.withColumn("_r", F.when(forward, computed).otherwise(F.col("regression_labels")))
    classes = F.transform("_r", lambda x: classify(x, threshold).cast("long")) if threshold is not None else F.lit(None).cast("array<bigint>")
    got = got.withColumn("labels", F.when(forward, classes).otherwise(F.col("labels"))).withColumn("regression_labels", F.col("_r"))
    if validate:
        require_none(row_problems(got, labelled=True))
    return got.select("split", "day", "seq", *columns, "labels", "regression_labels", "label_source")


def split_matrix(spark: SparkSession, path: str, split: str, keep: list[int] | None = None) -> DataFrame:
    """(day, seq, features): the last steps of a split as flat vectors, optionally only the features at ``keep``."""
    rows = day_files(spark, path, ["split", "day", "seq", "features"]).where(F.col("split") == split)
    picked = F.col("features") if keep is None else F.array(*[F.get("features", F.lit(i)) for i in keep])
    return rows.select("day", "seq", picked.alias("features"))
