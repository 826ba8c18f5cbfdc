"""Rank correlations of the replicates of a block bootstrap, with ranks taken anew in each replicate.

A replicate is a weight of each row: how often the row lies in a drawn block. Rows carry the weights of a batch of replicates
side by side, and three passes of grouped tasks take the ranks of all of them at once:

1. Rows lie in chunks of the sequence, a row of arrays each; a chunk meets its draws and gives its rows their weights.
2. Rows lie in buckets of about ``SPAN`` by their rank of y among all rows; running sums of weights over a bucket are ranks
   within it, and the buckets' totals (written, then a table of buckets x replicates in the tasks) give the rest.
3. The same for each treatment's buckets, which send the sums over ranks of y times ranks of the treatment.

Rows that are equal in all ranks are one row with the sum of their weights, first within a chunk, then within a bucket of y.
A value in more than 4 x ``SPAN`` rows is a bucket of its own: all its rows have one rank, so it is dealt to many tasks.

What lies on disk at once: a row costs half a byte a replicate on the way to its bucket of y, and from there (as a table, and
as one treatment's shuffle) some 2.5 bytes each. Batches hold about ``HELD`` rows x replicates, treatments are taken one
after another, and each batch deletes its table, so replicates add time and no disk. No row is repeated per replicate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, scratch

#: Rows of a chunk or bucket, and replicates side by side. SLICE: replicates that a task multiplies at once.
SPAN, BATCH, SLICE = 1 << 14, 256, 32
#: Rows x replicates of a batch, about, and the fewest replicates of one, as each reads all rows.
HELD, LEAST = 1 << 30, 16
#: Rows of the sequence among which equal rows meet in one task, at the most one for each chunk.
NEAR = 24


def packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix of counts, of the narrowest width that holds all of them, from four bits on."""
    top = int(x.max()) if x.size else 0
    if top < 16:
        x = x.astype(np.uint8)
        half = x[:, ::2].copy()
        half[:, : x.shape[1] // 2] |= x[:, 1::2] << 4
        x = half
    x = np.ascontiguousarray(x, np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 31 else np.int64)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpacked(values: pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix (rows, ``width``) again; rows may come from tasks that took different widths."""
    out = np.empty((len(values), width), np.int32)
    # A single replicate takes a byte either way.
    kinds = {(width + 1) // 2: None, width: np.uint8, 2 * width: np.uint16, 4 * width: np.uint32, 8 * width: np.int64}
    at = 0
    for chunk in values.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if len(chunk) else np.zeros(0, np.uint8)
        # Runs of rows of one width.
        sizes = np.diff(offsets)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                kind, own, to = kinds[int(sizes[a])], data[offsets[a] : offsets[b]], slice(at + a, at + b)
                if kind is None:
                    half = own.reshape(b - a, -1)
                    out[to, ::2], out[to, 1::2] = half & 15, half[:, : width // 2] >> 4
                    continue
                if kind is np.int64 and out.dtype != np.int64:
                    out = out.astype(np.int64)
                out[to] = own.view(kind).reshape(b - a, width)
        at += len(chunk)
    return out


def equal_rows(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows by ``keys``, the first one first, and where rows begin that differ from the one before."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.flatnonzero(new)


def summed(w: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rows of ``w`` in ``order``, added up from each of ``starts`` to the next."""
    if w.dtype != np.int64 and len(w) and int(w.max()) * len(w) >= 1 << 30:
        w = w.astype(np.int64)
    w = w[order]
    return w if len(starts) == len(w) else np.add.reduceat(w, starts, 0)


def ranks_within(place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(twice the mean rank, less one, of each row among the weighted rows, sums of cubed counts of equal values)."""
    order, starts = equal_rows([place])
    count = summed(w, order, starts)
    upto = count.cumsum(0, dtype=count.dtype)
    group = np.empty(len(place), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(place)]))
    t = count.astype(float)
    upto *= 2
    upto -= count
    return upto[group], np.einsum("ij,ij,ij->j", t, t, t)


def bucket(c: str) -> Column:
    """The bucket of a row by its r_<c>: a value of its own (then s_<c> is a part of it), or about ``SPAN`` rows."""
    return F.when(F.col(f"s_{c}") >= 0, F.col(f"r_{c}")).otherwise(F.floor(F.col(f"r_{c}") / (2 * SPAN)) * (2 * SPAN))


def bucketed(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """(i, and for each column c: r_c twice its rank, s_c the part of a bucket that is one value, else -1).

    Buckets are in the order of values: one value's bucket spans more than four others. Rows that are equal in all ranks
    lie in the same part, apart from those far from each other in the sequence.
    """
    twice = {c: F.round(2 * F.col(f"_r_{c}")).cast("long") for c in columns}
    rows = ranked.select("i", *[v.alias(f"r_{c}") for c, v in twice.items()])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r_{c}").alias("r")) for c in columns]))
    heavy = materialize(rows.select(each.alias("x")).groupBy("x.column", "x.r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * SPAN), "heavy-values")
    dealt = F.xxhash64(*[f"r_{c}" for c in columns], F.shiftright("i", NEAR))
    for c in columns:
        own = heavy.where(F.col("column") == c).select(F.col("r").alias(f"r_{c}"), F.col("n").alias("_n"))  # fewer than rows / SPAN
        rows = rows.join(F.broadcast(own), f"r_{c}", "left")
        rows = rows.withColumn(f"s_{c}", F.coalesce(F.pmod(dealt, F.ceil(F.col("_n") / SPAN)), F.lit(-1)).cast("int")).drop("_n")
    return rows


def chunked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each chunk of ``rows`` (as ``bucketed`` gives them): place, its rows' places, those of equal rows side by side;
    first, where each different row begins among them; and those rows' r_c and s_c. All are arrays in binary."""
    named = [f"{part}_{c}" for c in columns for part in "rs"]
    span = SPAN

    def gather(own: pa.Table) -> pa.Table:
        chunk = own["_chunk"][0].as_py()
        order, starts = equal_rows([own[f"r_{c}"].to_numpy() for c in columns])
        place = (own["i"].to_numpy() - chunk * span)[order]
        arrays = {"place": place.astype(np.int32), "first": starts.astype(np.int32), **{c: own[c].to_numpy()[order[starts]] for c in named}}
        return pa.table({"_chunk": pa.array([chunk], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})

    kinds = ", ".join(f"`{c}` binary" for c in ("place", "first", *named))
    return rows.withColumn("_chunk", F.floor(F.col("i") / span)).groupBy("_chunk").applyInArrow(gather, f"_chunk long, {kinds}")


def weighted(chunks: DataFrame, drawn: DataFrame, columns: list[str], length: int, first: int, width: int) -> DataFrame:
    """(r_c and s_c of each of ``columns``, w): the different rows of each chunk with their weights in the ``width`` replicates
    from ``first`` on. ``drawn``: (replicate, start) of these."""
    chunk = lambda c: F.floor(c / SPAN)
    reached = drawn.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("start")), chunk(F.col("start") + length - 1))))
    types = {f"{part}_{c}": kind for c in columns for part, kind in (("r", np.int64), ("s", np.int32))}
    kinds = ", ".join(f"`{c}` {'long' if t is np.int64 else 'int'}" for c, t in types.items())
    span = SPAN

    def weigh(own: pa.Table, draws: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({**{c: pa.array([], pa.from_numpy_dtype(t)) for c, t in types.items()}, "w": pa.array([], pa.binary())})
        array = lambda c, kind: np.frombuffer(own[c][0].as_py(), kind)
        base = own["_chunk"][0].as_py() * span
        start, rep = draws["start"].to_numpy() - base, draws["replicate"].to_numpy() - first
        begins, ends = (np.bincount(np.clip(at, 0, span) * width + rep, minlength=(span + 1) * width) for at in (start, start + length))
        w = (begins - ends).reshape(span + 1, width).cumsum(0)
        w = summed(w, array("place", np.int32), array("first", np.int32))
        return pa.table({**{c: pa.array(array(c, t)) for c, t in types.items()}, "w": packed(w)})

    return chunks.groupBy("_chunk").cogroup(reached.groupBy("_chunk")).applyInArrow(weigh, f"{kinds}, w binary")


def ranked_by_y(chunks: DataFrame, drawn: DataFrame, y: str, treatments: list[str], length: int, first: int, width: int) -> DataFrame:
    """Two kinds of rows for each bucket of y. Those with a null total: (r_t and s_t of each treatment, ky, w, u), the different rows of
    the bucket ky with their weights and u, twice their mean rank of y within it, less one. One more: its ``total`` weights, ``cubes``
    of the counts of equal values, and whether it is ``one`` value."""
    passed = [f"{part}_{t}" for t in treatments for part in "rs"]
    kinds = ", ".join(f"`{c}` {'int' if c.startswith('s_') else 'long'}" for c in passed)
    fields = [*passed, "ky", "w", "u", "total", "cubes", "one"]

    def rank_y(own: pa.Table) -> pa.Table:
        one = own[f"s_{y}"][0].as_py() >= 0
        order, starts = equal_rows([own[f"r_{c}"].to_numpy() for c in (y, *treatments)])
        w = summed(unpacked(own["w"], width), order, starts)
        own = own.select([*passed, f"r_{y}", "ky"]).take(order[starts])
        u, cubes = (np.zeros_like(w), np.zeros(width)) if one else ranks_within(own[f"r_{y}"].to_numpy(), w)
        got = own.select([*passed, "ky"]).append_column("w", packed(w)).append_column("u", packed(u))
        total = {"ky": own["ky"][:1], "total": pa.array([w.sum(0, dtype=np.int64).tobytes()]), "cubes": pa.array([cubes.tobytes()]), "one": pa.array([one])}
        return pa.concat_tables([got, pa.table(total)], promote_options="default").select(fields)

    rows = weighted(chunks, drawn, [y, *treatments], length, first, width).withColumn("ky", bucket(y))
    return rows.groupBy("ky", f"s_{y}").applyInArrow(rank_y, f"{kinds}, ky long, w binary, u binary, total binary, cubes binary, one boolean")


def batch_correlations(chunks: DataFrame, drawn: DataFrame, y: str, treatments: list[str], length: int, first: int, width: int) -> list[DataFrame]:
    """(replicate, treatment, ic) of ``width`` replicates from ``first`` on, written, one for each treatment; ``chunks`` as ``chunked`` gives them."""
    spark = chunks.sparkSession
    with scratch(ranked_by_y(chunks, drawn, y, treatments, length, first, width), "replicates-of-y") as ranked:
        # A row per bucket, of 16 bytes a replicate.
        found: dict[int, list] = {}
        for r in ranked.where("total IS NOT NULL").select("ky", "total", "cubes", "one").toLocalIterator():
            held = found.setdefault(r[0], [np.zeros(width, np.int64), np.zeros(width), r.one])
            held[0] += np.frombuffer(r.total, np.int64)
            held[1] += np.frombuffer(r.cubes)
        keys = np.array(sorted(found))
        totals, ones = np.array([found[k][0] for k in keys]), np.array([found[k][2] for k in keys])
        t = totals.astype(float)
        ties = np.where(ones[:, None], t * t * t, np.array([found[k][1] for k in keys])).sum(0)
        base = spark.sparkContext.broadcast((keys, totals.cumsum(0) - totals + np.where(ones[:, None], (t + 1) / 2, 0.5)))
        try:
            return [materialize(correlations_with(ranked, base, ties, name, first, width), "replicate-correlations") for name in treatments]
        finally:
            base.destroy()


def correlations_with(ranked: DataFrame, base, ties: np.ndarray, treatment: str, first: int, width: int) -> DataFrame:
    """(replicate, treatment, ic) for one treatment. ``ranked`` as ``ranked_by_y`` gives it; ``base``: a broadcast (buckets of y in order,
    ranks before each of them); ``ties``: sums of cubed counts of equal y."""

    def cross(own: pa.Table) -> pa.Table:
        w, u = unpacked(own["w"], width), unpacked(own["u"], width)
        one = own["s_t"][0].as_py() >= 0
        known, before = base.value
        at = np.searchsorted(known, own["ky"].to_numpy())
        v, cubes = (None, np.zeros(width)) if one else ranks_within(own["r_t"].to_numpy(), w)
        z, x = np.zeros(width), np.zeros(width)
        for a in range(0, width, SLICE):
            b = slice(a, a + SLICE)
            wr = w[:, b] * (before[at, b] + u[:, b] / 2)
            z[b] = wr.sum(0)
            if not one:
                x[b] = (wr * (v[:, b] / 2)).sum(0)
        return pa.table({"k": pa.array([own["k"][0].as_py()] * width), "one": pa.array([one] * width), "replicate": np.arange(first, first + width), "t": w.sum(0, dtype=np.int64), "z": z, "x": x, "cubes": cubes})

    spark = ranked.sparkSession
    moved = ranked.where("total IS NULL").select(F.col(f"r_{treatment}").alias("r_t"), F.col(f"s_{treatment}").alias("s_t"), "ky", "w", "u").withColumn("k", bucket("t"))
    sums = moved.groupBy("k", "s_t").applyInArrow(cross, "k long, one boolean, replicate long, t long, z double, x double, cubes double")
    sums = sums.groupBy("replicate", "k", "one").agg(*[F.sum(c).alias(c) for c in ("t", "z", "x", "cubes")])
    earlier = F.coalesce(F.sum("t").over(Window.partitionBy("replicate").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per bucket
    t = F.col("t").cast("double")
    placed = sums.withColumn("_b", earlier + F.when(F.col("one"), (t + 1) / 2).otherwise(0.5))
    got = placed.groupBy("replicate").agg(F.sum(F.col("x") + F.col("_b") * F.col("z")).alias("_xy"), F.sum(F.when(F.col("one"), t * t * t).otherwise(F.col("cubes"))).alias("_tp"), F.sum("t").cast("double").alias("_w"))
    got = got.join(F.broadcast(spark.createDataFrame([(first + k, float(x)) for k, x in enumerate(ties)], "replicate long, _ty double")), "replicate")
    w = F.col("_w")
    vy, vp = ((w * w * w - F.col(c)) / 12 for c in ("_ty", "_tp"))
    ic = F.when((w >= 3) & (vy > 0) & (vp > 0), (F.col("_xy") - w * (w + 1) * (w + 1) / 4) / (F.sqrt(vy) * F.sqrt(vp)))
    return got.select("replicate", F.lit(treatment).alias("treatment"), ic.alias("ic"))


def batches(n: int, replicates: int) -> list[tuple[int, int]]:
    """(first, width) of each batch of replicates over ``n`` rows: about ``HELD`` rows x replicates, of like widths."""
    count = -(-replicates // max(LEAST, min(BATCH, HELD // max(n, 1))))
    ends = [replicates * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def reranked_correlations(ranked: DataFrame, drawn: Callable[[int, int], DataFrame], y: str, treatments: list[str], length: int, replicates: int) -> DataFrame:
    """(replicate, treatment, ic), written. ``ranked``: a written table with i and _r_<column>, in the order of the column's values;
    ``drawn``: gives (replicate, start) of so many replicates (second) from one (first) on."""
    columns = [y, *treatments]
    parts: list[DataFrame] = []
    with scratch(chunked(bucketed(ranked, columns), columns), "rows-in-chunks") as chunks:
        for first, width in batches(ranked.count(), replicates):
            parts += batch_correlations(chunks, drawn(first, width), y, treatments, length, first, width)
    return reduce(DataFrame.unionByName, parts)
