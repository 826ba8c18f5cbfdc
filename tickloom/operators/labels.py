"""Labels from forward prices. Rows whose window leaves the day have a null label; nothing crosses days.

The column functions are for ``windowed``, with ``after`` at least the horizon (and ``before`` the look back).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ticks import by_day, windowed

BPS = 1e4


def _complete(value: Column, rows: int, low: int, high: int) -> Column:
    """``value`` where the frame [low, high] is full."""
    return F.when(F.count(F.lit(1)).over(by_day().rowsBetween(low, high)) == rows, value)


def point_return(h: int, price: str = "price") -> Column:
    p = F.col(price)
    return (F.lead(p, h).over(by_day()) - p) / p * BPS


def smoothed_return(h: int, k: int, price: str = "price") -> Column:
    """Mean of [t+h-k, t+h] against mean of [t-k, t]."""
    past = _complete(F.avg(price).over(by_day().rowsBetween(-k, 0)), k + 1, -k, 0)
    future = _complete(F.avg(price).over(by_day().rowsBetween(h - k, h)), k + 1, h - k, h)
    return (future - past) / past * BPS


def mean_return(h: int, price: str = "price") -> Column:
    """Mean of [t+1, t+h] against the price at t."""
    p = F.col(price)
    return (_complete(F.avg(p).over(by_day().rowsBetween(1, h)), h, 1, h) - p) / p * BPS


def peak_return(h: int, price: str = "price") -> Column:
    """The return within [t+1, t+h] of largest size, with its sign; of two equal ones the rise."""
    p, frame = F.col(price), by_day().rowsBetween(1, h)
    up, down = (F.max(p).over(frame) - p) / p * BPS, (F.min(p).over(frame) - p) / p * BPS
    return _complete(F.when(F.abs(up) >= F.abs(down), up).otherwise(down), h, 1, h)


def forward_variance(rows: DataFrame, h: int, out: str, price: str = "price") -> DataFrame:
    """Adds ``out``: sum over [t+1, t+h] of squared one-step log returns."""
    step = {"_r": F.ln(F.col(price) / F.lag(price, 1).over(by_day()))}
    total = {out: _complete(F.sum(F.pow("_r", F.lit(2))).over(by_day().rowsBetween(1, h)), h, 1, h)}
    return windowed(rows, step, total, before=1, after=h).drop("_r")


def forward_prices(k: int, most_h: int, price: str = "price") -> Column:
    """array [t-k, ..., t+most_h], null where incomplete."""
    got = F.collect_list(price).over(by_day().rowsBetween(-k, most_h))
    return F.when(F.size(got) == k + most_h + 1, got)


def returns_from_forward(forward: Column, k: int, h: int) -> Column:
    """Point return at horizon h from a forward-price array whose column k is the price at t."""
    now = F.get(forward, F.lit(k))
    return (F.get(forward, F.lit(k + h)) - now) / now * BPS


def classify(value: Column, threshold: float = 8.0) -> Column:
    """1 above the threshold, -1 below its negative, else 0 (both strict)."""
    return F.when(value > threshold, 1).when(value < -threshold, -1).when(value.isNotNull(), 0)


def profit_labels(window: int, horizon: int, stride: int, threshold: float, price: str = "price") -> Column:
    """Mean of the next horizon // stride prices against the mean of the last ``window`` (fewer at the day's start);
    0 where the day ends first or the past is below 1e-8."""
    kf = horizon // stride
    past = F.avg(price).over(by_day().rowsBetween(-(window - 1), 0))
    future = F.avg(price).over(by_day().rowsBetween(1, kf))
    whole = F.lead(price, kf).over(by_day()).isNotNull() & (past >= 1e-8)
    move = F.try_divide(future - past, past) * BPS
    return F.when(~whole, 0).otherwise(classify(move, threshold))


SHIFTED = {"tlob": 1, "opportunity": 1, "trend": 1, "triple_barrier": 0, "regression": 0}


def label_shift(strategy: str | None, metadata_strategy: str | None = None, note: str | None = None) -> int:
    """What is added to labels {-1, 0, 1} so that classes count from 0: by strategy, else metadata, else note, else 1."""
    for name in (strategy, metadata_strategy):
        if name is not None and name.lower() in SHIFTED:
            return SHIFTED[name.lower()]
    if note is not None and "0, 1, 2" in note:
        return 0
    return 1


def shift_by_strategy(label: Column, strategy: Column) -> Column:
    """The same for strategies in a column; unknown ones shift."""
    known = F.create_map(*[F.lit(x) for pair in SHIFTED.items() for x in pair])
    return label + F.coalesce(F.element_at(known, F.lower(strategy)), F.lit(1))


def binary_signal(label: Column) -> Column:
    """1 for the outer of three classes 0, 1, 2."""
    return label.isin(0, 2).cast("long")


def label_map(horizons: list[int], labels: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(h) for h in horizons]), labels)


def horizon_slice(labels: Column, horizons: list[int], index: int) -> Column:
    if not 0 <= index < len(horizons):
        raise ValueError(f"horizon index {index} is not within the {len(horizons)} horizons")
    return F.get(labels, F.lit(index))


def weight_horizon(index: int | None, horizons: list[int]) -> int | None:
    """The horizon that sample weights use: the largest if none is named, None if the index is out of range."""
    if index is None:
        return max(horizons) if horizons else None
    return horizons[index] if 0 <= index < len(horizons) else None


def task_of(strategy: str | None) -> str:
    """classification for the label strategies, regression for all else."""
    return "classification" if strategy in ("tlob", "triple_barrier", "opportunity", "trend") else "regression"


def label_source(requested: str, columns: list[str]) -> str:
    """auto takes precomputed labels where there are any, else forward prices."""
    if requested == "auto":
        requested = "precomputed" if "labels" in columns else "forward_prices"
    need = {"precomputed": "labels", "forward_prices": "forward_prices"}[requested]
    if need not in columns:
        raise ValueError(f"label source {requested} needs a column {need}")
    return requested


def sample_weights(rows: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
    """Adds weight: mean over a label's span of 1 / (labels that cover the step), divided by the mean of its day.

    Row i of a day of n rows stands at step i x stride, and its label spans the ``horizon`` steps from there. A step's
    cover follows from n, so nothing is exploded: each row sums 1 / cover over its own ``stride`` steps, and differences
    of running sums give whole spans; steps after the last row's own are added up where spans reach them.
    """
    per_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    n, start, long = F.col("_n"), F.col("seq") * stride, lambda k: F.lit(k).cast("long")

    def inverse(t: Column) -> Column:
        newest = F.least(F.floor(t / stride), n - 1)
        oldest = F.greatest(F.floor((t - horizon + stride) / stride), long(0))
        return 1.0 / (newest - oldest + 1)

    def total(first: Column, last: Column) -> Column:
        """Over the steps first to last; 0 if there are none."""
        steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(F.transform(steps, inverse), F.lit(0.0), lambda s, x: s + x)

    whole, rest = divmod(horizon, stride)
    upto = F.sum("_own").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    end = F.last("_upto").over(by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = F.coalesce(F.lead("_upto", whole - 1).over(by_day()), end) - F.col("_upto") + F.col("_own") if whole else F.lit(0.0)
    part = F.coalesce(F.lead("_part", whole).over(by_day()), F.lit(0.0)) if rest else F.lit(0.0)
    tail = total(F.greatest(n * stride, start), start + (horizon - 1))
    got = windowed(
        rows.join(per_day, "day"),
        {"_own": total(start, start + (stride - 1)) if stride > 1 else inverse(start), "_part": total(start, start + (rest - 1)) if rest else F.lit(0.0)},
        {"_upto": upto},
        {"_w": (blocks + part + tail) / horizon},
        after=whole + 1,
    ).drop("_n", "_own", "_part", "_upto")
    means = got.groupBy("day").agg(F.avg("_w").alias("_mean"))
    return got.join(means, "day").withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def warn_if_smoothed(return_type: str) -> bool:
    """Whether labels are smoothed returns, which an execution at one price does not earn; then a warning is given."""
    if return_type != "smoothed_return":
        return False
    warnings.warn("labels are smoothed returns: they differ from the point return of an execution at the horizon", UserWarning, stacklevel=2)
    return True
