"""Data-quality checks: each a single aggregate; ``require`` turns violations into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if


class ContractError(ValueError):
    """Data or metadata break the contract of an export."""


def column_quality(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, feature, n, n_null, n_nan, n_inf)."""
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_f")).select(*by, "_f.*")
    x = F.col("x")
    return each.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), count_if(x.isNull()).alias("n_null"), count_if(F.isnan(x)).alias("n_nan"), count_if(F.abs(x) == float("inf")).alias("n_inf"))


def label_domain(rows: DataFrame, label: str, allowed: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """(label, n, allowed): the labels that occur."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.coalesce(F.col("label").isin(*allowed), F.lit(False)))


def reserved_nonzero(rows: DataFrame, index: int = 97, features: str = "features") -> DataFrame:
    return rows.agg(count_if(F.get(features, F.lit(index)) != 0).alias("n_nonzero"))


def split_chronology(rows: DataFrame) -> DataFrame:
    """(split, first_day, last_day, n_days, follows): whether a split begins strictly after the one before ends."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    spans = rows.groupBy("split").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("n_days")).withColumn("_o", order)
    before = F.lag("last_day").over(Window.orderBy("_o"))  # one row per split
    return spans.withColumn("follows", F.coalesce(F.col("first_day") > before, F.lit(True))).drop("_o")


def require_metadata(meta: DataFrame, schema_version: str, n_features: int | None = None) -> None:
    """Schema version present and equal, one feature count, horizons equal on all days."""
    got = meta.agg(
        F.count(F.lit(1)).alias("n"),
        count_if(~F.col("schema_version").eqNullSafe(F.lit(schema_version))).alias("bad_schema"),
        F.countDistinct("n_features").alias("widths"),
        F.max("n_features").alias("width"),
        F.countDistinct("horizons").alias("horizons"),
    ).first()
    if got.n == 0:
        raise ContractError("there is no metadata")
    if got.bad_schema:
        raise ContractError(f"{got.bad_schema} days are not of schema {schema_version}")
    if got.widths != 1 or (n_features is not None and got.width != n_features):
        raise ContractError("feature counts differ")
    if got.horizons > 1:
        raise ContractError("horizons differ between days")


def horizons_of(meta: DataFrame) -> list[int]:
    """The horizons, which must be those of every day."""
    found = meta.select("horizons").distinct().limit(2).collect()
    if len(found) != 1 or found[0].horizons is None:
        raise ContractError("horizons are missing or differ between days")
    return list(found[0].horizons)


def require_finite(rows: DataFrame, columns: list[str]) -> None:
    bad = column_quality(rows, columns, []).where("n_null + n_nan + n_inf > 0").collect()
    if bad:
        raise ContractError(f"values that are not finite: {[(r.feature, r.n_null, r.n_nan, r.n_inf) for r in bad]}")


def check_setup(expected: dict, found: dict) -> list[str]:
    """Differences between what a configuration expects and what an export has, of the keys both name."""
    return [f"{k}: expected {expected[k]!r}, found {found[k]!r}" for k in sorted(expected.keys() & found.keys()) if expected[k] != found[k]]


#: What a complete entry of an experiment ledger states; patterns of its text.
ENTRY_FIELDS = {"date": r"\d{4}-\d{2}-\d{2}", "metric": r"(?i)\b(accuracy|ic|r2|mae)\b", "config": r"(?i)config"}


def audit_entries(entries: DataFrame, text: str = "text", fields: dict[str, str] | None = None) -> DataFrame:
    """Adds has_<field> for each pattern, n_numbers and complete."""
    fields = fields or ENTRY_FIELDS
    got = entries.select("*", *[F.col(text).rlike(p).alias(f"has_{k}") for k, p in fields.items()], F.size(F.regexp_extract_all(text, F.lit(r"[0-9]+"), 0)).alias("n_numbers"))
    complete = F.lit(True)
    for k in fields:
        complete = complete & F.col(f"has_{k}")
    return got.withColumn("complete", complete)
