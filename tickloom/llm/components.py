"""Connected components of links by alternating large and small stars.

Before each round the tasks put stars in place of the edges they hold, so rounds are few; each costs the driver several plans.
Once no more edges are left than a task contracts at once, one task's stars end it, so rounds are for more edges than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Edges that a task contracts at once.
PIECE = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node): edges from the smallest node of each component of these edges to its others."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a][apart], root[b][apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, that connect the same nodes: those of each ``PIECE`` of a partition as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PIECE:
                yield star(held)
                held = []
        if held:
            yield star(held)

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("u", "v"))
    return edges.select("u", "v").mapInArrow(run, kinds)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (u, v), for each node of an edge.

    A hub's many edges meet its least neighbour in a broadcast (``join_groups``), so they are no one task's work.
    """
    written = lambda found: materialize(contracted(found).distinct(), "edges")
    of = lambda edges: tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    state = of(edges)
    for _ in range(most_rounds):
        if state[0] <= PIECE:
            # All that is left is a piece: its stars are the components.
            edges = materialize(contracted(edges.coalesce(1)), "edges")
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_groups(both.where("v > u"), least, ["u"], "n", 2 * state[0]).select("v", "m").where("v <> m").distinct()
        # In ``large`` each v points at smaller nodes: its least becomes the hub of the others.
        hub = large.groupBy("v").agg(F.min("m").alias("hub"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, hub, ["v"], "n", 2 * state[0]).select(F.col("hub").alias("u"), F.explode(F.array("v", "m")).alias("v")).where("u <> v").distinct()
        edges = written(small)
        before, state = state, of(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
