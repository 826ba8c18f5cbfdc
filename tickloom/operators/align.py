"""Aligning sources: every positional pairing is an inner join on (day, seq), which also trims to the shorter side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


def common_days(*sources: DataFrame) -> DataFrame:
    """The days that all sources have."""
    return reduce(lambda a, b: a.intersect(b), [s.select("day").distinct() for s in sources])


def days_without(left: DataFrame, right: DataFrame) -> DataFrame:
    """The days of ``left`` that ``right`` lacks."""
    return left.select("day").distinct().join(right.select("day").distinct(), "day", "left_anti")


def name_differences(wanted: list[str], known: list[str]) -> dict[str, list[str]]:
    """missing: wanted but not known; unexpected: known but not wanted. In order, for error messages and drift checks."""
    return {"missing": sorted(set(wanted) - set(known)), "unexpected": sorted(set(known) - set(wanted))}


def require_common_days(*sources: DataFrame) -> DataFrame:
    days = common_days(*sources)
    if days.isEmpty():
        raise ValueError("the sources have no day in common")
    return days


def align(sources: dict[str, DataFrame], primary: str, values: list[str]) -> DataFrame:
    """One row per (day, seq) that all sources have, values named <source>_<value>: the primary first, others by name."""
    order = [primary, *sorted(n for n in sources if n != primary)]
    renamed = [sources[n].select("day", "seq", *[F.col(v).alias(f"{n}_{v}") for v in values]) for n in order]
    return reduce(lambda a, b: a.join(b, ["day", "seq"]), renamed)


def fuse(rows: DataFrame, parts: list[str], out: str = "features") -> DataFrame:
    """Adds ``out``: the concatenated feature vectors of ``parts``, in their order."""
    return rows.withColumn(out, F.concat(*parts))


def fuse_sequences(a: Column, b: Column) -> Column:
    """Steps side by side: two sequences of equal length become one of wider steps."""
    return F.zip_with(a, b, lambda x, y: F.concat(x, y))


def alignment_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(day, n_left, n_right, n_both)."""
    a = left.groupBy("day").agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy("day").agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, "day", "full_outer").na.fill(0)
    return both.withColumn("n_both", F.least("n_left", "n_right"))


def require_aligned(left: DataFrame, right: DataFrame) -> None:
    """Raises unless both sides have the same (day, seq)."""
    keys = ["day", "seq"]
    both = left.select(*keys, F.lit(1).alias("_l")).join(right.select(*keys, F.lit(1).alias("_r")), keys, "full_outer")
    bad = both.where(F.col("_l").isNull() | F.col("_r").isNull()).count()
    if bad:
        raise ValueError(f"{bad} rows have no counterpart")


def paired(treatments: dict[str, DataFrame], label: str = "y", pred: str = "yhat") -> DataFrame:
    """One row per (day, seq) with the label and a prediction per treatment; raises if labels differ."""
    names = sorted(treatments)
    parts = [treatments[n].select("day", "seq", F.col(label).alias(f"_y_{n}"), F.col(pred).alias(n)) for n in names]
    rows = reduce(lambda a, b: a.join(b, ["day", "seq"]), parts)
    same = reduce(lambda a, b: a & b, [F.col(f"_y_{names[0]}").eqNullSafe(F.col(f"_y_{n}")) for n in names])
    if not rows.where(~same).isEmpty():
        raise ValueError("the treatments' labels differ")
    return rows.select("day", "seq", F.col(f"_y_{names[0]}").alias(label), *names)


def drop_nonfinite(rows: DataFrame, columns: list[str], most: float = 0.05) -> tuple[DataFrame, float]:
    """Rows in which all of ``columns`` are finite and the share dropped; raises if it exceeds ``most``."""
    ok = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("kept")).first()
    share = 1 - counts.kept / counts.n if counts.n else 0.0
    if share > most:
        raise ValueError(f"{share:.4f} of the rows are not finite; at most {most} may be")
    return rows.where(ok), share


def pairs(names: list[str]) -> list[tuple[str, str]]:
    names = sorted(names)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def subsample(rows: DataFrame, n: int, seed: int, keys: list[str], drawn: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same in every run, in the order of ``keys``.

    Those of least ``drawn`` are taken, by default a hash of the keys and the seed.
    """
    drawn = F.xxhash64(*keys, F.lit(seed)) if drawn is None else drawn
    return rows.orderBy(drawn, *keys).limit(n).orderBy(*keys)


def day_of(rows: DataFrame, boundaries: DataFrame, index: str = "index") -> DataFrame:
    """Adds day to rows with a global index, from (day, first, last), a partition of the indices.

    An equi-join on ranges of ``step`` indices (the mean length of a day), with each day in the ranges it touches.
    """
    step = boundaries.agg(F.max("last"), F.count(F.lit(1))).first()
    step = max(1, ((step[0] or 0) + 1) // max(step[1], 1))
    spans = boundaries.withColumn("_range", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor(F.col("last") / step))))
    got = rows.withColumn("_range", F.floor(F.col(index) / step)).join(spans, "_range")
    return got.where(F.col(index).between(F.col("first"), F.col("last"))).drop("first", "last", "_range")
