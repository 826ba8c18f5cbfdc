"""Feature selection and rolling temporal features.

All rolling features share one window, so one sort serves them; the column functions are for ``windowed``, with
``before`` at least the longest frame less one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nulled
from ..sources.ticks import by_day, windowed

#: Feature sets by name; ranges of the fixed feature layout.
PRESETS: dict[str, tuple[int, ...]] = {
    "lob_only": tuple(range(40)),
    "lob_derived": tuple(range(48)),
    "full": tuple(range(98)),
    "full_116": tuple(range(116)),
    "full_128": tuple(range(128)),
    "no_meta": tuple(range(92)),
    "signals_full": tuple(range(84, 98)),
    "lob_signals": (*range(40), *range(84, 98)),
    "signals_core": tuple(range(84, 92)),
    "full_98": tuple(range(98)),
    # All but the features that never change: 68, 69, 76, 77, 92, 94, 96, 97, 102.
    "analysis_ready_128": tuple(i for i in range(128) if i not in (68, 69, 76, 77, 92, 94, 96, 97, 102)),
    "deeplob_extended": (*range(40), 40, 41, 45, 46, *range(84, 92)),
    "short_term_40": (0, 1, 10, 11, 20, 21, 30, 31, *range(40, 47), *range(48, 60), *range(84, 95), 104, 105),
}


def check_indices(indices: list[int], width: int | None = None) -> list[int]:
    if not indices:
        raise ValueError("no feature is selected")
    if len(set(indices)) != len(indices):
        raise ValueError("a feature is selected twice")
    if min(indices) < 0 or (width is not None and max(indices) >= width):
        raise ValueError("a feature index is out of range")
    return list(indices)


def select_features(features: Column, indices: list[int], width: int | None = None) -> Column:
    """The elements at ``indices``; all of them in order is the array itself."""
    indices = check_indices(indices, width)
    if width is not None and indices == list(range(width)):
        return features
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(features, i))


def index_mapping(spark: SparkSession, indices: list[int]) -> DataFrame:
    """(local, source) places of the selected features."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in check_indices(indices)])).alias("local", "source"))


def load_feature_set(text: str, contract: str | None = None) -> dict:
    """A feature set record (JSON): required keys, content hash over sorted unique indices, width and contract version."""
    import hashlib

    got = json.loads(text)
    missing = {"name", "indices", "source_feature_count", "contract_version", "content_hash", "description"} - got.keys()
    if missing:
        raise ValueError(f"a feature set lacks {sorted(missing)}")
    body = {"indices": sorted(set(got["indices"])), "source_feature_count": got["source_feature_count"], "contract_version": got["contract_version"]}
    if hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != got["content_hash"]:
        raise ValueError("a feature set's content differs from its hash")
    if contract is not None and got["contract_version"] != contract:
        raise ValueError(f"a feature set of contract {got['contract_version']} does not fit {contract}")
    check_indices(got["indices"], got["source_feature_count"])
    return got


def _full(value: Column, w: int) -> Column:
    return F.when(F.count(F.lit(1)).over(by_day().rowsBetween(-(w - 1), 0)) == w, value)


def rolling_mean(x: str, w: int) -> Column:
    return _full(F.avg(x).over(by_day().rowsBetween(-(w - 1), 0)), w)


def rolling_std(x: str, w: int) -> Column:
    return _full(F.stddev_pop(x).over(by_day().rowsBetween(-(w - 1), 0)), w)


def rolling_slope(x: str, w: int) -> Column:
    """Least-squares slope per step over the last ``w`` rows: sums of x and seq x give it without a second frame."""
    frame = by_day().rowsBetween(-(w - 1), 0)
    # With t = 0..w-1 inside the frame: sum (t - mean t) x / sum (t - mean t)^2.
    t_x = F.sum(F.col("seq") * F.col(x)).over(frame) - (F.col("seq") - (w - 1)) * F.sum(x).over(frame)
    return _full((t_x - (w - 1) / 2 * F.sum(x).over(frame)) / (w * (w * w - 1) / 12), w)


def rate_of_change(x: str, w: int) -> Column:
    return F.col(x) - F.lag(x, w - 1).over(by_day())


def momentum(x: str, short: int = 5, long: int = 20) -> Column:
    return rolling_mean(x, short) - rolling_mean(x, long)


def log_return(price: str = "price", floor: float = 1e-6) -> Column:
    """The one-step log return within the day; prices below the floor count as 1."""
    p = F.when(F.col(price) < floor, 1.0).otherwise(F.col(price))
    return F.ln(p) - F.ln(F.lag(p, 1).over(by_day()))


def realized_vol(logret: str, w: int) -> Column:
    """Deviation of the last ``w`` log returns, scaled by the root of ``w``."""
    full = F.count(logret).over(by_day().rowsBetween(-(w - 1), 0)) == w
    return F.when(full, F.stddev_pop(logret).over(by_day().rowsBetween(-(w - 1), 0)) * F.sqrt(F.lit(float(w))))


def realized_vol_bps(logret: str, w: int) -> Column:
    """Root of the summed squares of the last ``w`` log returns, in basis points."""
    frame = by_day().rowsBetween(-(w - 1), 0)
    return F.when(F.count(logret).over(frame) == w, F.sqrt(F.sum(F.pow(logret, F.lit(2))).over(frame)) * 1e4)


def cross_products(columns: list[str]) -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def sequences(rows: DataFrame, features: Column, window: int, stride: int = 1) -> DataFrame:
    """Adds sequence: the last ``window`` feature vectors, kept where complete and on the stride."""
    got = windowed(rows, {"sequence": F.collect_list(features).over(by_day().rowsBetween(-(window - 1), 0))}, before=window - 1)
    return got.where((F.size("sequence") == window) & ((F.col("seq") - (window - 1)) % stride == 0))


@dataclass(frozen=True)
class TemporalSet:
    """What ``temporal_features`` makes columns of; names are columns of the rows.

    ``top`` of the signals have rolling columns over ``windows``. Context and regime are last values again, as the set's
    order has them.
    """

    signals: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    context: tuple[str, ...]
    regime: tuple[str, ...]
    price: str = "price"
    top: int = 3
    windows: tuple[int, ...] = (5, 10, 20)
    deviation_window: int = 10
    volatility_windows: tuple[int, ...] = (10, 5)
    momentum_windows: tuple[int, int] = (5, 20)

    def __post_init__(self):
        if not 0 < self.top <= len(self.signals):
            raise ValueError(f"{self.top} of {len(self.signals)} signals can't be rolled")
        if min(self.windows + self.volatility_windows + self.momentum_windows + (self.deviation_window,)) < 2:
            raise ValueError("a window is shorter than two steps")


def order_book_set(name: Callable[[int], str] = "f{}".format) -> TemporalSet:
    """The set of the order-book feed; ``name`` gives the column of a feature of the fixed layout.

    Fixed values: signals 85, 84, 86, 56, 45; products 85x84, 85x86, 85x45, 84x56, 84x86, 86x45; context 42, 45, 54, 40,
    95; regime 93, 95; mid price 40.
    """
    pairs = ((85, 84), (85, 86), (85, 45), (84, 56), (84, 86), (86, 45))
    return TemporalSet(
        tuple(name(i) for i in (85, 84, 86, 56, 45)),
        tuple((name(a), name(b)) for a, b in pairs),
        tuple(name(i) for i in (42, 45, 54, 40, 95)),
        tuple(name(i) for i in (93, 95)),
        name(40),
    )


def temporal_features(rows: DataFrame, of: TemporalSet) -> DataFrame:
    """Adds, in this order (53 columns for five signals, three of them rolled): last values of the signals; rolling means,
    slopes and changes; products; context; regime; deviations and the price's volatility; momentum.

    Columns are named <kind>_<column>[_<window>]; frames that are not full give null.
    """
    top, w, (short, long) = of.signals[: of.top], of.windows, of.momentum_windows
    frame = lambda k: by_day().rowsBetween(-(k - 1), 0)
    # Sums over each frame are taken once; means, slopes and momentum follow from them.
    sums: dict[str, Column] = {}
    for k in sorted({*w, short, long}):
        sums[f"_n_{k}"] = F.count(F.lit(1)).over(frame(k))
        sums |= {f"_s_{s}_{k}": F.sum(s).over(frame(k)) for s in top}
    sums |= {f"_t_{s}_{k}": F.sum(F.col("seq") * F.col(s)).over(frame(k)) for s in top for k in w}
    sums |= {f"change_{s}_{k}": rate_of_change(s, k) for s in top for k in w}
    sums |= {f"std_{s}_{of.deviation_window}": rolling_std(s, of.deviation_window) for s in top}
    sums |= {f"volatility_{k}": realized_vol("_logret", k) for k in of.volatility_windows}
    full = lambda k, value: F.when(F.col(f"_n_{k}") == k, value)
    mean = lambda s, k: full(k, F.col(f"_s_{s}_{k}") / k)
    slope = lambda s, k: full(k, (F.col(f"_t_{s}_{k}") - (F.col("seq") - (k - 1) / 2) * F.col(f"_s_{s}_{k}")) / (k * (k * k - 1) / 12))
    added: dict[str, Column] = {f"last_{s}": F.col(s) for s in of.signals}
    added |= {f"mean_{s}_{k}": mean(s, k) for s in top for k in w}
    added |= {f"slope_{s}_{k}": slope(s, k) for s in top for k in w}
    added |= {f"change_{s}_{k}": F.col(f"change_{s}_{k}") for s in top for k in w}
    added |= {f"product_{a}_{b}": F.col(a) * F.col(b) for a, b in of.pairs}
    added |= {f"context_{c}": F.col(c) for c in of.context}
    added |= {f"regime_{c}": F.col(c) for c in of.regime}
    added |= {f"std_{s}_{of.deviation_window}": F.col(f"std_{s}_{of.deviation_window}") for s in top}
    added |= {f"volatility_{k}": F.col(f"volatility_{k}") for k in of.volatility_windows}
    added |= {f"momentum_{s}": mean(s, short) - mean(s, long) for s in top}
    reach = max(*w, of.deviation_window, *of.volatility_windows, short, long)
    return windowed(rows, {"_logret": log_return(of.price)}, sums, before=reach).select(*rows.columns, *[c.alias(n) for n, c in added.items()])


def finite_rows(rows: DataFrame, features: str = "features") -> DataFrame:
    """The rows whose features are all finite."""
    return rows.where(F.forall(features, lambda x: F.coalesce(nulled(x).isNotNull(), F.lit(False))))


def book_valid(rows: DataFrame, index: int = 92, features: str = "features", by: str = "day") -> DataFrame:
    """Rows whose valid flag is over 0.5; all rows of a day without any."""
    ok = F.coalesce(F.get(features, F.lit(index)) > 0.5, F.lit(False))
    some = rows.groupBy(F.col(by).alias("_by")).agg(F.max(ok.cast("int")).alias("_some"))
    return rows.join(some, F.col(by).eqNullSafe(F.col("_by"))).where(ok | (F.col("_some") == 0)).drop("_by", "_some")
