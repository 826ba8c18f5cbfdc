"""Regression, ranking and correlation metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite, ratio, share, sign
from ..sources.shared import join_counted, materialize, scratch
from ..sources.ticks import row_before, windowed
from .labels import point_return
from .quantiles import exact_quantiles, with_quantiles


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Correlation; null for fewer than ``least`` rows or a constant side (corr raises there under ANSI rules)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= least) & (spread > 1e-14), F.try_divide(F.covar_pop(x, y), spread))


def _ranked(rows: DataFrame, value: str, by: list[str], out: str, weight: str, buckets: int) -> DataFrame:
    """Adds ``out``: the rank of ``value`` within ``by`` from 1, ties getting the mean of their ranks; null for null.

    A row counts ``weight`` times. Each group's values are cut into ranges at its own approximate quantiles, so that a rank
    over all rows is not one task's work: running counts come from windows over ranges plus the totals of the ranges
    before. One row of ``buckets`` numbers per group is broadcast, so ``by`` is meant for few groups (features,
    horizons, event types).
    """
    # All branches read the same columns, so that they share one exchange of ``rows``.
    known = F.col(value).isNotNull() & (F.col(weight) > 0)
    cuts = rows.where(known).groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 1000).alias("_cuts"))
    # Binary search: halving steps over the cuts.
    steps = F.array(*[F.lit(2**k) for k in reversed(range((buckets - 1).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(F.col("_cuts"), at + s - 1) < F.col(value), F.lit(False)), at + s).otherwise(at))
    placed = (rows.join(F.broadcast(cuts), by, "left") if by else rows.crossJoin(F.broadcast(cuts))).withColumn("_b", F.when(known, place)).drop("_cuts")
    totals = placed.where(known).groupBy(*by, "_b").agg(F.sum(weight).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_b", before.alias("_before"))
    # Peers are in the frame, so the running count is that of the last of equal values.
    upto = F.sum(weight).over(Window.partitionBy(*by, "_b").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum(weight).over(Window.partitionBy(*by, "_b", value))
    got = placed.withColumn("_upto", upto).withColumn("_peers", peers).join(F.broadcast(totals), [*by, "_b"], "left")
    rank = F.when(known, (F.col("_before") + F.col("_upto") - (F.col("_peers") - 1) / 2).cast("double"))
    return got.withColumn(out, rank).drop("_b", "_before", "_upto", "_peers")


def counted_ranks(rows: DataFrame, values: dict[str, Column], by: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """(column, by, v, rank, n), written: the mean rank of each distinct value of each of ``values`` within ``by``, and its rows.

    Equal values are counted in the tasks before anything is ranked, so a value that many rows share is one row here.
    """
    by = by or []
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), c.cast("double").alias("v")) for name, c in values.items()]))
    each = rows.select(*by, stacked.alias("_s")).select(*by, "_s.*").where("v IS NOT NULL")
    with scratch(each.groupBy("column", *by, "v").agg(F.count(F.lit(1)).alias("n")), "counted-values") as counts:
        return materialize(_ranked(counts, "v", ["column", *by], "rank", "n", buckets).select("column", *by, "v", "rank", "n"), "counted-ranks")


def with_counted_ranks(rows: DataFrame, ranks: DataFrame, values: dict[str, Column], total: int, by: list[str] | None = None) -> DataFrame:
    """``rows`` with the rank of each of ``values`` (not null) in a column of its name; heavy values are broadcast."""
    by = by or []
    for name, c in values.items():
        own = ranks.where(F.col("column") == name).select(*by, F.col("v").alias("_v"), F.col("rank").alias(name), F.col("n").alias("_n"))
        rows = join_counted(rows.withColumn("_v", c.cast("double")), own, [*by, "_v"], "_n", total).drop("_v", "_n")
    return rows


def average_ranks(rows: DataFrame, value: str, by: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Adds ``out``: the rank of ``value`` within ``by`` (few groups, not null) from 1, ties getting the mean of their ranks;
    null for null. Values are counted first and ranks come back by value, so a value in many rows is no one task's work."""
    ranks = counted_ranks(rows, {out: F.col(value)}, by, buckets)
    total = ranks.agg(F.sum("n")).first()[0] or 0
    known = with_counted_ranks(rows.where(F.col(value).isNotNull()), ranks, {out: F.col(value)}, total, by)
    return known.unionByName(rows.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def weighted_pearson(x: Column, y: Column, n: Column, least: int) -> Column:
    """Correlation of rows that count ``n`` times, from sums."""
    total, sx, sy = F.sum(n), F.sum(n * x), F.sum(n * y)
    cov, vx, vy = F.sum(n * x * y) - sx * sy / total, F.sum(n * x * x) - sx * sx / total, F.sum(n * y * y) - sy * sy / total
    spread = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
    return F.when((total >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(cov, spread))


def spearman(rows: DataFrame, x: str, y: str, by: list[str], out: str = "ic", least: int = 3, buckets: int = 64, weight: str | None = None) -> DataFrame:
    """(by, ic, n): rank correlation with mean ranks for ties; null for fewer than ``least`` rows. A row counts ``weight`` times.

    Equal pairs are counted first and written, as they are read several times. Ranks are taken over each side's counted values
    and come back by value, heavy values by broadcast: a value that most pairs share is one row to rank and no one task's join.
    """
    # A group may be null: joins see it inside a struct.
    group = F.struct(F.lit(0).alias("_0"), *by).alias("_g")
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    pairs = materialize(pairs, "value-pairs")
    ranked, total = pairs, pairs.count()
    for side in ("_x", "_y"):
        counts = materialize(pairs.groupBy("_g", side).agg(F.sum("_n").alias("_w"), F.count(F.lit(1)).alias("_size")), "counted-values")
        ranks = materialize(_ranked(counts, side, ["_g"], f"_r{side}", "_w", buckets).select("_g", side, f"_r{side}", "_size"), "counted-ranks")
        ranked = join_counted(ranked, ranks, ["_g", side], "_size", total).drop("_size")
    got = ranked.groupBy(*(["_g"] if by else [])).agg(weighted_pearson(F.col("_r_x"), F.col("_r_y"), F.col("_n"), least).alias(out), F.sum("_n").alias("n"))
    return got.select(*[F.col(f"_g.{c}").alias(c) for c in by], out, "n")


def r_squared(y: Column, p: Column) -> Column:
    """1 - SSE / SST; 0 for a constant target; may be negative."""
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 1e-12, 1 - F.try_divide(F.sum(F.pow(y - p, F.lit(2))), sst)).otherwise(0.0)


def directional_accuracy(y: Column, p: Column) -> Column:
    """Share of rows with equal sign among those with y <> 0; 0.5 if there are none."""
    return ratio(count_if((y != 0) & (sign(y) == sign(p))), count_if(y != 0), None)


def profitable_accuracy(y: Column, p: Column, breakeven: float = 5.0) -> Column:
    """Share of rows with equal sign among those that move more than ``breakeven``; 0 if there are none."""
    large = F.abs(y) > breakeven
    return ratio(count_if(large & (sign(y) == sign(p))), count_if(large))


def moment_metrics(y: Column, p: Column, breakeven: float = 5.0) -> dict[str, Column]:
    """All metrics that are functions of sums: one aggregate."""
    return {
        "r2": r_squared(y, p),
        "pearson": pearson(y, p),
        "mae": F.avg(F.abs(y - p)),
        "rmse": F.sqrt(F.avg(F.pow(y - p, F.lit(2)))),
        "directional_accuracy": F.coalesce(directional_accuracy(y, p), F.lit(0.5)),
        "profitable_accuracy": profitable_accuracy(y, p, breakeven),
    }


def regression_metrics(rows: DataFrame, by: list[str], y: str = "y", p: str = "yhat", breakeven: float = 5.0) -> DataFrame:
    """(by, r2, ic, pearson, mae, rmse, directional_accuracy, profitable_accuracy, n)."""
    full = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    metrics = [m.alias(name) for name, m in moment_metrics(F.col(y), F.col(p), breakeven).items()]
    moments = full.groupBy(*by).agg(*metrics, F.count(F.lit(1)).alias("n"))
    ic = spearman(full, y, p, by).drop("n")
    return moments.join(ic, by) if by else moments.crossJoin(ic)  # one row per group each


def by_horizon(rows: DataFrame, horizons: list[int], yhat: str = "yhat", price: str = "price") -> DataFrame:
    """(horizon, y, yhat): the point returns of several horizons, stacked after one window pass."""
    wide = windowed(rows.select("day", "seq", F.col(price).alias("_p"), F.col(yhat).alias("yhat")), {f"_y{h}": point_return(h, "_p") for h in horizons}, after=max(horizons))
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y")) for h in horizons]))
    return wide.select("yhat", pairs.alias("_x")).select(F.col("_x.horizon").alias("horizon"), F.col("_x.y").alias("y"), "yhat").where(F.col("y").isNotNull())


def hit_tripwire(rows: DataFrame, y: str = "y", p: str = "yhat") -> DataFrame:
    """Directional accuracy on moves that are not 0, their number, and the lag-1 autocorrelation of hits within days."""
    moved = rows.where(F.col(y) != 0).withColumn("_hit", F.when(sign(F.col(y)) == sign(F.col(p)), 1.0).otherwise(0.0))
    chained = row_before(moved.select("day", "seq", "_hit"), "_hit", "_before")
    got = chained.agg(F.avg("_hit").alias("da"), F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("_s"), F.sum(F.col("_hit") * F.col("_before")).alias("_xy"), F.sum(F.when(F.col("_before").isNotNull(), F.col("_hit"))).alias("_x"), F.sum("_before").alias("_y"), F.count("_before").alias("_pairs"))
    # Sum (x - m)(x' - m) over pairs / sum (x - m)^2 over all, from sums.
    m = F.col("da")
    num = F.col("_xy") - m * (F.col("_x") + F.col("_y")) + F.col("_pairs") * m * m
    den = F.col("n") * m * (1 - m)
    return got.select("da", "n", ratio(num, den).alias("hit_autocorrelation"))


def feature_correlations(rows: DataFrame, features: list[str], label: str, flat: float = 1e-10, mark: float = 0.01) -> DataFrame:
    """(feature, r, n, direction): Pearson with the label, 0 for a flat feature; +, - or 0 by ``mark``."""
    each = rows.select(F.col(label).cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_f"))
    got = each.groupBy(F.col("_f.feature").alias("feature")).agg(F.when(F.stddev_pop("_f.x") < flat, 0.0).otherwise(F.coalesce(pearson(F.col("_f.x"), F.col("_y")), F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("direction", F.when(F.col("r") > mark, "+").when(F.col("r") < -mark, "-").otherwise("0"))


def screening(rows: DataFrame, features: list[str], labels: dict[int, str], flat: float = 1e-10, mark: float = 0.01) -> DataFrame:
    """(horizon, feature, r, p, n, direction, rank, place, best): features against the label of each horizon.

    ``p``: two-sided p-value (1 for a flat feature); ``rank``: by size of r within the horizon; ``place``: by size within
    the horizon and direction, null where there is no direction (the strongest five each way have place 5 or less);
    ``best``: whether the horizon is the one where the feature's r is largest in size. One scan; what follows has one row
    per feature and horizon.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for h, y in labels.items() for f in features]))
    each = rows.select(stacked.alias("_f")).select("_f.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = F.when(F.stddev_pop("x") < flat, 0.0).otherwise(F.coalesce(pearson(F.col("x"), F.col("y")), F.lit(0.0)))
    got = each.groupBy("horizon", "feature").agg(r.alias("r"), F.count(F.lit(1)).alias("n")).withColumn("direction", F.when(F.col("r") > mark, "+").when(F.col("r") < -mark, "-").otherwise("0"))
    p = F.udf(lambda r, n: 1.0 if r == 0 else correlation_p_value(r, n), "double")  # one call per feature and horizon
    size = F.abs("r").desc()
    got = got.withColumn("p", p("r", "n")).withColumn("rank", F.row_number().over(Window.partitionBy("horizon").orderBy(size, "feature")))
    got = got.withColumn("place", F.when(F.col("direction") != "0", F.row_number().over(Window.partitionBy("horizon", "direction").orderBy(size, "feature"))))
    return got.withColumn("best", F.row_number().over(Window.partitionBy("feature").orderBy(size, "horizon")) == 1)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t with n - 2 degrees of freedom (continued fraction of the beta integral)."""
    if n < 3 or abs(r) >= 1:
        return 1.0 if n < 3 else 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def ic_gate(rows: DataFrame, features: list[str], label: str, least_ic: float = 0.05, least_features: int = 3, flat: float = 1e-10) -> DataFrame:
    """(feature, ic, passes, gate_passed): features by rank correlation with the label; the gate asks for enough of them."""
    each = rows.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_f")).select("y", "_f.*")
    spread = each.groupBy("feature").agg(F.stddev_pop("x").alias("_s"))
    got = spearman(each, "x", "y", ["feature"]).join(spread, "feature").withColumn("ic", F.when(F.col("_s") < flat, 0.0).otherwise(F.coalesce("ic", F.lit(0.0)))).drop("_s")
    got = got.withColumn("passes", F.abs("ic") > least_ic)
    return got.withColumn("gate_passed", F.sum(F.col("passes").cast("int")).over(Window.partitionBy()) >= least_features)  # one row per feature


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """mean, std (population), min, max, median, p90 of the finite values. ``rows`` are scanned several times."""
    x = F.when(finite(F.col(value)), F.col(value))
    got = rows.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quantiles(got, exact_quantiles(rows, value, [0.5, 0.9], []), [], ["median", "p90"])


def move_magnitudes(rows: DataFrame, horizons: list[int], gate: Column, levels: tuple[float, ...] = (0, 1, 2, 2.15, 3, 5, 10), cost: float = 1.40, delta: float = 0.50) -> DataFrame:
    """Per horizon over the gated rows: moves in the predicted direction, their quantiles and shares above ``levels``,
    the entry price, the move that pays for ``cost`` and the net result of an option of ``delta`` on 100 shares."""
    price = F.col("price")
    wide = windowed(rows.select("day", "seq", "price", "pred", gate.alias("_gate")), {f"_m{h}": point_return(h) for h in horizons}, after=max(horizons)).where("_gate")
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_m{h}").alias("raw")) for h in horizons]))
    each = wide.select("price", "pred", pairs.alias("_x")).select("price", "pred", "_x.*").where(F.col("raw").isNotNull())
    each = materialize(each.withColumn("move", F.when(F.col("pred") == 2, F.col("raw")).otherwise(-F.col("raw"))).drop("pred"), "moves")
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = each.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("move").alias("mean"),
        F.stddev_pop("move").alias("std"),
        F.min("move").alias("min"),
        F.max("move").alias("max"),
        F.avg("raw").alias("raw_mean"),
        F.stddev_pop("raw").alias("raw_std"),
        F.avg(F.abs("raw")).alias("raw_abs_mean"),
        *[share(F.col("move") > level).alias(f"share_over_{str(level).replace('.', '_')}") for level in levels],
        F.avg(price).alias("entry_price"),
    )
    sizes = exact_quantiles(each.select("horizon", F.abs("raw").alias("size")), "size", [0.5], ["horizon"])
    got = with_quantiles(got, sizes, ["horizon"], ["raw_abs_median"])
    got = with_quantiles(got, exact_quantiles(each, "move", q, ["horizon"]), ["horizon"], [f"p{int(100 * x)}" for x in q])
    dollar = delta * F.col("entry_price") / 1e4 * 100
    got = got.withColumn("breakeven", ratio(F.lit(cost), dollar)).withColumn("gross", F.col("mean") * dollar)
    return got.withColumn("net", F.col("gross") - cost)


def first_profitable(moves: DataFrame) -> DataFrame:
    return moves.agg(F.min(F.when(F.col("net") > 0, F.col("horizon"))).alias("first_profitable_horizon"))


def fold_summary(folds: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over folds; 0 for fewer than two."""
    return folds.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{value}_std"), F.count(F.lit(1)).alias("n_folds"))


def best_epoch(epochs: DataFrame, loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """The first epoch of smallest finite loss, over all rows or for each key in ``by``."""
    return epochs.where(finite(F.col(loss))).groupBy(*(by or [])).agg(F.min_by("epoch", F.struct(loss, "epoch")).alias("best_epoch"), F.min(loss).alias("best_loss"))
