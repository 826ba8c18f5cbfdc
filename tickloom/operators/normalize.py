"""Feature statistics and normalization. Statistics come from the training split and are applied as literals or joins.

``features`` is array<double>; statistics explode it once and aggregate partially, so each task sends one row per feature.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip, finite
from .quantiles import exact_quantiles, with_quantiles

#: Columns of the raw book (below 40) that hold prices and sizes, by layout; fixed values.
LAYOUTS = {
    "grouped": ([*range(0, 10), *range(20, 30)], [*range(10, 20), *range(30, 40)]),
    "lobster": ([*range(0, 40, 2)], [*range(1, 40, 2)]),
}
ALIASES = {"grouped": "grouped", "extended": "grouped", "lobster": "lobster", "fi2010": "lobster", "interleaved": "lobster"}
#: Control columns that are never scaled; fixed values.
EXCLUDED = (92, 93, 94, 96, 97, 115)


def layout(name: str) -> tuple[list[int], list[int]]:
    """(price columns, size columns) of a layout or one of its other names."""
    key = name.lower()
    for alias, own in ALIASES.items():
        if key == alias or alias in key:
            return LAYOUTS[own]
    raise ValueError(f"unknown layout {name}")


def is_sequence(rows: DataFrame, features: str) -> bool:
    """Whether ``features`` holds steps of vectors, not one vector."""
    return rows.schema[features].dataType.simpleString().startswith("array<array")


def each_step(rows: DataFrame, features: str, scaled) -> Column:
    """``scaled`` (a vector's column -> its scaled column) of the vector, or of each step's."""
    return F.transform(features, scaled) if is_sequence(rows, features) else scaled(F.col(features))


def exploded(rows: DataFrame, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """(keys, idx, x): finite values only, of all steps of a sequence."""
    if is_sequence(rows, features):
        rows = rows.withColumn(features, F.explode(features))
    return rows.select(*(keys or []), F.posexplode(features).alias("idx", "x")).where(finite(F.col("x")))


def group_of(idx: Column, price_size: tuple[list[int], list[int]]) -> Column:
    """price, size or feature."""
    prices, sizes = price_size
    return F.when(idx.isin(*prices), "price").when(idx.isin(*sizes), "size").otherwise("feature")


def pooled_stats(rows: DataFrame, price_size: tuple[list[int], list[int]], features: str = "features") -> DataFrame:
    """(kind, mean, std, n): one mean and population deviation over all price columns, one over all size columns."""
    each = exploded(rows, features).withColumn("kind", group_of(F.col("idx"), price_size)).where("kind <> 'feature'")
    return each.groupBy("kind").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count(F.lit(1)).alias("n"))


def hybrid_stats(rows: DataFrame, price_size: tuple[list[int], list[int]], excluded: tuple[int, ...] = EXCLUDED, features: str = "features", flat: float = 1e-8) -> DataFrame:
    """(idx, mean, std): pooled for the book's prices and sizes, per feature beyond, 0 and 1 for excluded ones; a flat
    feature has deviation 1. Means merge as counts, sums and squares of partial aggregates, as Spark's moments do."""
    idx = F.col("idx")
    kind = group_of(idx, price_size)
    each = exploded(rows, features).withColumn("_g", F.when(kind == "feature", idx).when(kind == "price", -1).otherwise(-2))
    stats = each.groupBy("_g").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    one = F.get(features, F.lit(0)) if is_sequence(rows, features) else F.col(features)
    width = rows.agg(F.max(F.size(one)).alias("w"))
    every = width.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("idx")).withColumn("_g", F.when(kind == "feature", idx).when(kind == "price", -1).otherwise(-2))
    got = every.join(stats, "_g", "left")
    out = idx.isin(*excluded) if excluded else F.lit(False)
    std = F.when(F.coalesce("_s", F.lit(0.0)) < flat, 1.0).otherwise(F.col("_s"))
    return got.select("idx", F.when(out, 0.0).otherwise(F.coalesce("_m", F.lit(0.0))).alias("mean"), F.when(out, 1.0).otherwise(std).alias("std"), out.alias("excluded"))


def stats_arrays(stats: DataFrame) -> DataFrame:
    """One row: means, stds and excluded as arrays by idx."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "mean", "std", "excluded")))
    return stats.agg(ordered.alias("s")).select(F.col("s.mean").alias("means"), F.col("s.std").alias("stds"), F.col("s.excluded").alias("excluded"))


def apply_hybrid(rows: DataFrame, stats: DataFrame, features: str = "features", limit: float = 10.0) -> DataFrame:
    """z-scores clipped to the limit in place of ``features``, a vector or steps of vectors; excluded columns as they are.
    ``stats``: one row per feature."""
    one = stats_arrays(stats)
    z = lambda v: F.transform(v, lambda x, i: F.when(F.get("excluded", i), x).otherwise(clip((x - F.get("means", i)) / F.get("stds", i), -limit, limit)))
    return rows.join(F.broadcast(one)).withColumn(features, each_step(rows, features, z)).drop("means", "stds", "excluded")


def apply_global(rows: DataFrame, pooled: DataFrame, price_size: tuple[list[int], list[int]], features: str = "features", eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (std + eps) for price and size columns; the others untouched. ``pooled``: two rows."""
    one = pooled.agg(*[F.max(F.when(F.col("kind") == k, F.col(m))).alias(f"_{k}_{m}") for k in ("price", "size") for m in ("mean", "std")])

    def scaled(x: Column, i: Column) -> Column:
        kind = group_of(i, price_size)
        return F.when(kind == "price", (x - F.col("_price_mean")) / (F.col("_price_std") + eps)).when(kind == "size", (x - F.col("_size_mean")) / (F.col("_size_std") + eps)).otherwise(x)

    return rows.join(F.broadcast(one)).withColumn(features, each_step(rows, features, lambda v: F.transform(v, scaled))).drop(*one.columns)


def feature_statistics(rows: DataFrame, by: list[str], features: str = "features", floor: float = 1e-8) -> DataFrame:
    """(by, idx, mean, std, min, max, median, q25, q75, iqr, n) of the finite values; deviations not below ``floor``.

    ``rows`` are scanned several times (``exact_quantiles``).
    """
    each, keys = exploded(rows, features, by), [*by, "idx"]
    got = each.groupBy(*keys).agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count(F.lit(1)).alias("n"))
    got = with_quantiles(got, exact_quantiles(each, "x", [0.25, 0.5, 0.75], keys), keys, ["q25", "median", "q75"])
    return got.select(*keys, "mean", "std", "min", "max", "median", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "n")


def column_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same of scalar columns, named: one aggregate over as many columns as asked, stacked."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_f")).select("_f.*").where(finite(F.col("x")))
    return each.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count(F.lit(1)).alias("n"))


class DegenerateFeatures(ValueError):
    """Features that cannot be scaled; ``indices`` and ``reason`` (no_finite_value or no_variance, then with ``eps``)."""

    def __init__(self, indices: list[int], reason: str, eps: float | None = None):
        self.indices, self.reason, self.eps = indices, reason, eps
        super().__init__(f"features without a finite value: {indices}" if reason == "no_finite_value" else f"features that vary by less than {eps}, and are not excluded: {indices}")


def require_finite_columns(rows: DataFrame, features: str = "features", excluded: tuple[int, ...] = (), eps: float | None = None) -> None:
    """Raises if a feature has no finite value in any row, or (``eps``) varies by less, unless it is excluded. One aggregate."""
    if is_sequence(rows, features):
        rows = rows.select(F.explode(features).alias(features))
    x = F.when(finite(F.col("x")), F.col("x"))
    stats = rows.select(F.posexplode(features).alias("idx", "x")).groupBy("idx").agg(F.count(x).alias("n"), F.stddev_pop(x).alias("s"))
    stats = stats.where(~F.col("idx").isin(*excluded)) if excluded else stats
    flat = F.lit(False) if eps is None else F.col("s") < eps
    bad = stats.where((F.col("n") == 0) | flat).orderBy("idx").collect()  # a row per feature
    empty = [r.idx for r in bad if r.n == 0]
    if empty:
        raise DegenerateFeatures(empty, "no_finite_value")
    if bad:
        raise DegenerateFeatures([r.idx for r in bad], "no_variance", eps)


def zscore_per_day(rows: DataFrame, value: str, out: str, by: str = "day", flat: float = 1e-10) -> DataFrame:
    """Adds ``out``, the z-score within each day: moments are aggregated (a row per day) and joined back."""
    stats = rows.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_std") < flat, 1.0).otherwise(F.col("_std"))
    return rows.join(stats, by).withColumn(out, z).drop("_mean", "_std")


def plain_zscore(value: Column, mean: Column, std: Column, flat: float = 1e-10) -> Column:
    """0 for what is not finite."""
    z = (value - mean) / F.when(std < flat, 1.0).otherwise(std)
    return F.when(finite(z), z).otherwise(0.0)


def scale_columns(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """minmax to [0, 1] or robust by median and quartiles, over all rows: one row of statistics, joined back."""
    if how == "minmax":
        one = rows.agg(*[x for c in columns for x in (F.min(c).alias(f"_{c}_a"), (F.max(c) - F.min(c)).alias(f"_{c}_b"))])
    elif how == "robust":
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_f")).select("_f.*")
        q = exact_quantiles(each, "x", [0.25, 0.5, 0.75], ["column"])
        of = lambda c, k: F.max(F.when(F.col("column") == c, F.get("quantiles", F.lit(k))))
        one = q.agg(*[x for c in columns for x in (of(c, 1).alias(f"_{c}_a"), (of(c, 2) - of(c, 0)).alias(f"_{c}_b"))])
    else:
        raise ValueError(f"unknown scaling {how}")
    out = rows.join(F.broadcast(one))
    for c in columns:
        width = F.when(F.abs(f"_{c}_b") < 1e-10, 1.0).otherwise(F.col(f"_{c}_b"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_{c}_a")) / width)
    return out.drop(*one.columns)


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def cached_stats(spark: SparkSession, path: str, compute, parameters: dict) -> DataFrame:
    """Statistics of an earlier run with the same parameters, else computed and written beside them."""
    want = json.dumps(parameters, sort_keys=True)
    try:
        found = spark.read.parquet(path)
        if "parameters" in found.columns and found.select("parameters").distinct().count() == 1 and found.first()["parameters"] == want:
            return found.drop("parameters")
    except Exception as error:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    save_stats(compute().withColumn("parameters", F.lit(want)), path)
    return spark.read.parquet(path).drop("parameters")
