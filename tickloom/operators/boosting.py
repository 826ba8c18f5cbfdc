"""Gradient-boosted regression trees with Huber loss, grown from histograms.

Features are cut into bins once. Each level of a tree is one aggregate over the rows: counts and sums of the bounded
residuals per node, feature and bin, added up in the tasks; the driver sees nodes x features x bins numbers and picks the splits.
Rows hold their bins, their target and the forecast so far, and are written anew every ``every`` trees, so lineage stays short.

For each tree, of the rows drawn for it (a hash of the row and the tree): the bound is the ``alpha`` quantile of the sizes
of the residuals; a split maximizes the sum of squared sums over counts of both sides, with at least ``leaf`` rows on each (ties: the first
feature, the lowest cut); a leaf's value is the median residual and the mean of what is left of the residuals, bounded. Quantiles are
Spark's with an accuracy of ``ACCURACY``: exact up to so many rows, within a rank of 1 / ``ACCURACY`` beyond.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..sources.shared import materialize

ACCURACY = 10_000


@dataclass
class Tree:
    """Inner nodes by number (1 is the root, 2 k and 2 k + 1 the sides of k): (feature, last bin of the left side); leaves' values."""

    splits: dict[int, tuple[int, int]]
    values: dict[int, float]


@dataclass
class HuberTrees:
    features: list[str]
    cuts: list[list[float]]
    base: float
    step: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Forecasts for rows of features."""
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            node = np.ones(len(x), np.int64)
            for k in sorted(tree.splits):
                at = node == k
                j, last = tree.splits[k]
                node[at] = 2 * k + (bins[at, j] > last)
            out += self.step * np.array([tree.values[k] for k in node])
        return out

    def to_json(self) -> str:
        trees = [{"splits": {str(k): list(v) for k, v in t.splits.items()}, "values": {str(k): v for k, v in t.values.items()}} for t in self.trees]
        return json.dumps({"features": self.features, "cuts": self.cuts, "base": self.base, "step": self.step, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> HuberTrees:
        body = json.loads(text)
        trees = [Tree({int(k): tuple(v) for k, v in t["splits"].items()}, {int(k): v for k, v in t["values"].items()}) for t in body.pop("trees")]
        return cls(**body, trees=trees)


def score_trees(rows: DataFrame, model: HuberTrees, out: str = "yhat") -> DataFrame:
    """Adds ``out``; null where a feature is not finite."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            columns = (batch,) if isinstance(batch, pd.Series) else batch  # a single column comes by itself
            x = np.stack([s.to_numpy(np.float64) for s in columns], 1)
            known = np.isfinite(x).all(1)
            got = np.full(len(x), np.nan)
            got[known] = model.predict(x[known])
            yield pd.Series(got)  # NaN becomes null

    return rows.withColumn(out, run(*[F.col(f).cast("double") for f in model.features]))


def node_of(splits: dict[int, tuple[int, int]]) -> Column:
    """The node of a row (bins b0, b1, ...) under the splits found so far."""

    def below(k: int) -> Column:
        if k not in splits:
            return F.lit(k)
        j, last = splits[k]
        return F.when(F.col(f"b{j}") <= last, below(2 * k)).otherwise(below(2 * k + 1))

    return below(1)


def best_splits(counts: list, features: int, leaf: int) -> dict[int, tuple[int, int]]:
    """The best split of each node from its histogram rows (node, feature, bin, n, s); nodes without a gain have none."""
    by_node: dict[int, dict[int, list]] = {}
    for r in counts:
        by_node.setdefault(r.node, {}).setdefault(r.feature, []).append((r.bin, r.n, r.s))
    found = {}
    for node, own in by_node.items():
        best = None
        for j in range(features):
            bins, n, s = (np.array(c) for c in zip(*sorted(own[j])))
            left_n, left_s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            right_n, right_s = n.sum() - left_n, s.sum() - left_s
            ok = (left_n >= leaf) & (right_n >= leaf)
            if not ok.any():
                continue
            gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - s.sum() ** 2 / n.sum(), -np.inf)
            # Sums come in any order, so gains equal but for rounding count as equal.
            at = int(np.flatnonzero(gain >= gain.max() - 1e-9 * abs(gain.max()))[0])
            if gain[at] > 1e-12 and (best is None or gain[at] > best[0] * (1 + 1e-9)):
                best = (gain[at], j, int(bins[at]))
        if best is not None:
            found[node] = best[1:]
    return found


def fit_huber_trees(rows: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 5, step: float = 0.05, share: float = 0.8, leaf: int = 50, alpha: float = 0.9, bins: int = 64, seed: int = 42, every: int = 5) -> HuberTrees:
    """Rows with a feature or label that is not finite take no part; raises if none is left."""
    ok = finite(F.col(label).cast("double"))
    for f in features:
        ok = ok & finite(F.col(f).cast("double"))
    kept = materialize(rows.where(ok).select(F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]), "boosting-rows")
    at = lambda c, p: F.percentile_approx(c, p, ACCURACY)
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    first = kept.agg(at("y", 0.5).alias("base"), *[at(f"x{j}", levels).alias(f"c{j}") for j in range(len(features))]).first()
    if first.base is None:
        raise ValueError("no row has finite features and label")
    cuts = [sorted(set(first[f"c{j}"])) for j in range(len(features))]

    def bin_of(j: int) -> Column:
        """How many cuts lie below the value, by halving steps."""
        held, x = F.array(*[F.lit(c) for c in cuts[j]]), F.col(f"x{j}")
        steps = F.array(*[F.lit(2**k) for k in reversed(range(len(cuts[j]).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.coalesce(F.get(held, a + s - 1) < x, F.lit(False)), a + s).otherwise(a))

    binned = kept.select("y", *[bin_of(j).cast("short").alias(f"b{j}") for j in range(len(features))], F.monotonically_increasing_id().alias("id"))
    table = materialize(binned.withColumn("f", F.lit(first.base)), "boosting-bins")
    model, pending = HuberTrees(list(features), cuts, first.base, step, []), 0
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f"b{j}").alias("bin")) for j in range(len(features))]))
    for t in range(trees):
        drawn = table.where(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("r", F.col("y") - F.col("f"))
        bound = drawn.agg(at(F.abs("r"), alpha)).first()[0]
        if bound is None:
            raise ValueError("no row was drawn for a tree")
        splits: dict[int, tuple[int, int]] = {}
        for level in range(depth):
            own = drawn.withColumn("node", node_of(splits)).where(F.col("node") >= 1 << level)
            held = own.select("node", F.greatest(F.least("r", F.lit(bound)), F.lit(-bound)).alias("g"), cells.alias("c"))
            counts = held.groupBy("node", "c.feature", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("s")).collect()  # nodes x features x bins
            new = best_splits(counts, len(features), leaf)
            if not new:
                break
            splits |= new
        placed = drawn.withColumn("node", node_of(splits))
        middle = {r.node: r.m for r in placed.groupBy("node").agg(at("r", 0.5).alias("m")).collect()}
        median = F.element_at(F.create_map(*[F.lit(x) for pair in middle.items() for x in pair]), F.col("node"))
        rest = F.col("r") - median
        means = placed.groupBy("node").agg(F.avg(F.signum(rest) * F.least(F.abs(rest), F.lit(bound))).alias("v")).collect()
        values = {r.node: middle[r.node] + r.v for r in means}
        model.trees.append(Tree(splits, values))
        change = F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), node_of(splits))
        table, pending = table.withColumn("f", F.col("f") + step * change), pending + 1
        if pending == every:
            table, pending = materialize(table, "boosting-bins"), 0
    return model
