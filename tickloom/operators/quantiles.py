"""Exact quantiles by selection: no task and no aggregate ever holds a column's values.

Each wanted rank has a range of values it is known to lie in, at first from the least to the largest value of its group. A
round cuts each such range into cells, counts the rows of each cell (added up in the tasks before they shuffle) and keeps the cell
that has the rank, with its exact least and largest value and the number of rows below it. Once all ranges hold few rows, or one
value only, their distinct values are counted and the ranks read off. Rows are scanned once a round and never sorted or
shuffled; what shuffles are the counts of cells.

The first round cuts in steps of a signed logarithm, so that a few huge values don't leave all others in one cell; later ones
cut in equal steps. A value that many rows share is a cell's least and largest value at once, or one distinct value
among few, and so takes no more rounds than others. The table of ranges has a row per group and rank; it is broadcast up to
``BROADCAST_ROWS`` rows, and joined by group beyond. The number of cells per range falls as there are more ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..sources.shared import materialize

#: Rows of a range whose distinct values are counted, most rounds before that, and most cells of all ranges together.
FEW, ROUNDS, CELLS = 100_000, 8, 1 << 22
#: Most ranges that are broadcast.
BROADCAST_ROWS = 200_000


def _signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _cell(x: Column, cells: int, curve) -> Column:
    """The place of ``x`` among ``cells`` steps from ``_lo`` to ``_hi``; never falls as ``x`` rises."""
    low, width = curve(F.col("_lo")), curve(F.col("_hi")) - curve(F.col("_lo"))
    return F.when(width > 0, F.least(F.floor((curve(x) - low) / width * cells).cast("int"), F.lit(cells - 1))).otherwise(0)


def exact_quantiles(rows: DataFrame, value: str, levels: list[float], by: list[str], few: int = FEW) -> DataFrame:
    """(by, n, quantiles array<double>): linear interpolation between the neighbouring ranks p (n - 1), as SQL's percentile.

    ``rows`` are scanned several times, so they should be read from files (``materialize`` what is costly to compute). Null
    and non-finite values are left out; a group without others has no row. Null keys are a group like any other.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    values = rows.select(*named, F.col(value).cast("double").alias("_x")).where(finite(F.col("_x")))
    spread = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # The ranks below and above each level.
    place = F.array(*[x for p in levels for x in (F.floor(F.lit(float(p)) * (F.col("_n") - 1)), F.ceil(F.lit(float(p)) * (F.col("_n") - 1)))])
    wanted = spread.select(*keys, F.col("_n").alias("_all"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n", F.posexplode(place).alias("_t", "_rank"))
    wanted = materialize(wanted, "wanted-ranks")

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    def narrowed(wanted: DataFrame, cell_of) -> DataFrame:
        """``wanted`` with the range of each rank cut down to its cell."""
        ranges = wanted.where("_lo < _hi").select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("_lo"), F.col("_hi"), F.col("_below")).distinct()
        side = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
        inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
        for k in keys:
            inside = inside & same(k, f"r{k}")
        held = values.join(side, inside).withColumn("_cell", cell_of)
        cells = held.groupBy(*keys, "_lo", "_hi", "_below", "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        earlier = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = cells.select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_a", "_b", "_c", (F.col("_below") + earlier).alias("_start"))
        meet = (F.col("_lo") == F.col("_from")) & (F.col("_hi") == F.col("_to")) & (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c"))
        for k in keys:
            meet = meet & same(k, f"r{k}")
        new = wanted.join(found, meet, "left")
        hit = F.col("_c").isNotNull()
        pick = lambda a, b: F.when(hit, F.col(a)).otherwise(F.col(b))
        return materialize(new.select(*keys, "_all", pick("_a", "_lo").alias("_lo"), pick("_b", "_hi").alias("_hi"), pick("_start", "_below").alias("_below"), pick("_c", "_n").alias("_n"), "_t", "_rank"), "wanted-ranks")

    for step in range(ROUNDS):
        left = wanted.where("_lo < _hi").agg(F.max("_n").alias("most"), F.count(F.lit(1)).alias("ranges")).first()
        if not left.ranges or left.most <= few:
            break
        cells = max(8, min(1024, CELLS // left.ranges))
        wanted = narrowed(wanted, _cell(F.col("_x"), cells, _signed_log if step == 0 else lambda x: x))
    if left.ranges:
        wanted = narrowed(wanted, F.col("_x"))

    got = wanted.groupBy(*keys).agg(F.max("_all").alias("n"), F.array_sort(F.collect_list(F.struct("_t", F.col("_lo").alias("v")))).alias("_v"))
    levels_ = []
    for i, p in enumerate(levels):
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col("_v")[2 * i]["v"], F.col("_v")[2 * i + 1]["v"]
        levels_.append(F.when(F.ceil(at) == F.floor(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return got.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", F.array(*levels_).alias("quantiles"))


def with_quantiles(stats: DataFrame, quantiles: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``stats`` (a row per group) with the quantiles in columns of these names, null for a group without values."""
    picked = quantiles.select(*[F.col(c).alias(f"_q_{c}") for c in by], *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(names)])
    if not by:
        return stats.join(picked, how="left")  # one row each
    meet = F.lit(True)
    for c in by:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return stats.join(picked, meet, "left").drop(*[f"_q_{c}" for c in by])
