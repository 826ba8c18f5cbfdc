"""Centroid clustering by delta Lloyd rounds over integer vectors.

Vectors are turned into integers once and written in chunks, dealt out to buckets by chunk. Assignments (each vector's owner
and its distance to it) are a second table of the same buckets, written anew by each round; so a round joins both without a
shuffle, and what it writes is a few bytes per vector. Global sums and counts by centroid are written too, after each round.

A round compares all vectors with the centroids that changed only. A vector whose owner stayed, or came no farther away, has
lost no other centroid by that; one whose owner moved away from it is compared with all. Vectors that change hands add
themselves to their new owner and subtract themselves from the old, in sums per chunk, and the global sums are the last
ones plus these signed transfers. All arithmetic is in integers, so results are those of full rounds, whatever the chunks.
Rounds in which no centroid changed are left out, as they change nothing.

The driver holds the centroids and sums (``k`` x ``width`` numbers), a task holds one chunk of ``CHUNK`` vectors.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; components
beyond 2**26 after scaling raise an error, since squared distances would not fit into 64 bits. Rows that repeat an id or
a vector are rows each; rows with a null id are clustered but are no first centroids, unless nothing else is left to be one;
equal hashes go by the vector. With fewer than ``k`` vectors there are so many centroids. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parts_for, shared_path

#: Vectors in a chunk, and chunks in a bucket.
CHUNK, PER_BUCKET = 4096, 16
#: Components must stay below this, so that distances of up to 1,024 components fit into 63 bits.
BOUND = 1 << 26


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale x) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = df.where(v.isNotNull()).where(good).select(F.col(f"`{id_col}`").alias("id"), scaled.alias("v"))
    sound = F.assert_true(F.array_max(F.transform("v", F.abs)) < BOUND, F.lit(f"a component is {BOUND / scale:g} or more"))
    return rows.where(sound.isNull())


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> list[tuple[int, ...]]:
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [tuple(r.v) for r in rows.collect()]


def chunked(vectors: DataFrame, width: int) -> DataFrame:
    """(chunk, ids array, v): up to ``CHUNK`` rows as one, the vectors as little-endian 32-bit integers."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def chunks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            at, n = 0, t.num_rows if t else 0
            while n - at >= CHUNK or (last and n > at):
                own = t.slice(at, CHUNK).combine_chunks()
                ids, v = own.column(0).chunk(0), own.column(1).chunk(0)
                flat = v.flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([flat.tobytes()], pa.binary())], ["chunk", "ids", "v"])
                at, number = at + CHUNK, number + 1
            held = t.slice(at).to_batches() if t and at < n else []

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from chunks(False)
        yield from chunks(True)

    return vectors.select("id", "v").mapInArrow(run, f"chunk long, ids array<{kind}>, v binary")


def store(df: DataFrame, buckets: int, tag: str) -> str:
    """Writes ``df`` in the shared folder as a table of ``buckets`` buckets by chunk; returns its name."""
    name = f"{tag}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "chunk").sortBy("chunk").option("path", shared_path(df.sparkSession, tag)).saveAsTable(name)
    return name


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exactly: rows of ``x`` against rows of ``c``."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids of numbers ``changed`` (ascending) have moved to where ``centroids`` has them.

    ``owner`` and ``distance`` are those before; an owner of -1 has none yet.
    """
    if not len(changed):
        return owner, distance
    near = squared(x, centroids[changed])
    moved = np.zeros(len(centroids) + 1, bool)
    moved[changed] = True
    place = np.zeros(len(centroids) + 1, np.int64)
    place[changed] = np.arange(len(changed))
    rows = np.arange(len(x))
    hit = moved[owner] & (owner >= 0)
    fresh = near[rows, place[owner]]
    left = (owner < 0) | (hit & (fresh > distance))
    held = np.where(hit, fresh, distance)
    # The first of equal minima has the smallest number.
    best = near.argmin(1)
    d, c = near[rows, best], changed[best]
    better = (d < held) | ((d == held) & (c < owner))
    new_owner, new_distance = np.where(better, c, owner), np.where(better, d, held)
    if left.any():
        every = squared(x[left], centroids)
        own = every.argmin(1)
        new_owner[left], new_distance[left] = own, every[np.arange(len(own)), own]
    return new_owner, new_distance


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """(k, width + 1): what each centroid gains and loses in counts (first) and sums."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    went = np.flatnonzero(before != after)
    for side, sign in ((after[went], 1), (before[went], -1)):
        some = side >= 0
        np.add.at(out[:, 0], side[some], sign)
        np.add.at(out[:, 1:], side[some], sign * x[went[some]])
    return out


def next_assignments(vectors: DataFrame, assigned: DataFrame | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """(chunk, owner binary, distance binary, moved binary): ``vectors`` and their last assignments, one row per chunk each.

    ``moved`` holds the chunk's transfers, null if no vector changed hands.
    """
    k, width = centroids.shape
    if assigned is None:
        none = F.lit(None).cast("binary")
        rows = vectors.select("chunk", "v", none.alias("owner"), none.alias("distance"))
    else:
        rows = vectors.select("chunk", "v").hint("merge").join(assigned.select("chunk", "owner", "distance"), "chunk").select("chunk", "v", "owner", "distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), "<i4").astype(np.int64).reshape(-1, width)
                owner, distance = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                before = np.full(len(x), -1, np.int64) if owner is None else np.frombuffer(owner, "<i4").astype(np.int64)
                far = np.full(len(x), -1, np.int64) if distance is None else np.frombuffer(distance, "<i8")
                after, far = reassign(x, before, far, centroids, changed)
                moved = transfers(x, before, after, k).tobytes() if (before != after).any() else None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([after.astype("<i4").tobytes()], pa.binary()), pa.array([far.astype("<i8").tobytes()], pa.binary()), pa.array([moved], pa.binary())], ["chunk", "owner", "distance", "moved"])

    return rows.mapInArrow(run, "chunk long, owner binary, distance binary, moved binary")


def add_transfers(sums: DataFrame, assigned: DataFrame, k: int, width: int) -> DataFrame:
    """(cluster, place, total): the last ``sums`` (of the same columns) plus the transfers of a round, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, place = np.divmod(np.arange(k * (width + 1)), width + 1)
        for batch in batches:
            total = sum(np.frombuffer(x.as_py(), "<i8") for x in batch.column(0))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cluster[some], pa.int32()), pa.array(place[some], pa.int32()), pa.array(total[some])], ["cluster", "place", "total"])

    moved = assigned.where("moved IS NOT NULL").select("moved").mapInArrow(run, "cluster int, place int, total long")
    each = sums.unionByName(moved.withColumn("total", F.col("total").cast("decimal(38,0)")))
    return each.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def moved_centroids(centroids: list[tuple[int, ...]], sums: DataFrame) -> list[tuple[int, ...]]:
    """floor(sum / count) for every centroid that owns vectors; the others stay."""
    width = len(centroids[0])
    total = [[0] * (width + 1) for _ in centroids]
    for r in sums.collect():  # k x (width + 1) numbers
        total[r.cluster][r.place] = int(r.total)
    return [tuple(s // t[0] for s in t[1:]) if t[0] else c for c, t in zip(centroids, total)]


def delta_lloyd(spark: SparkSession, vectors: DataFrame, centroids: list[tuple[int, ...]], rounds: int, buckets: int | None = None) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(id, cluster, distance) as a written table, and the final centroids. ``vectors``: (id, v), a written table."""
    k, width = len(centroids), len(centroids[0])
    chunks = chunked(vectors, width)
    if buckets is None:
        buckets = parts_for(vectors.count(), CHUNK * PER_BUCKET, least=spark.sparkContext.defaultParallelism)
    held = store(chunks.repartition(buckets, "chunk"), buckets, "vectors")
    names = [held]
    now = store(next_assignments(spark.table(held), None, np.array(centroids, np.int64), np.arange(k)), buckets, "owners")
    names.append(now)
    sums = spark.createDataFrame([], "cluster int, place int, total decimal(38,0)")
    for _ in range(rounds):
        sums = materialize(add_transfers(sums, spark.table(now), k, width), "cluster-sums")
        after = moved_centroids(centroids, sums)
        changed = np.array([i for i in range(k) if after[i] != centroids[i]], np.int64)
        centroids = after
        if not len(changed):
            break
        now = store(next_assignments(spark.table(held), spark.table(now), np.array(centroids, np.int64), changed), buckets, "owners")
        names.append(now)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                owner = np.frombuffer(batch.column(1)[i].as_py(), "<i4")
                distance = np.frombuffer(batch.column(2)[i].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([ids, pa.array(owner), pa.array(distance)], ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    both = spark.table(held).select("chunk", "ids").hint("merge").join(spark.table(now).select("chunk", "owner", "distance"), "chunk")
    rows = materialize(both.select("ids", "owner", "distance").mapInArrow(spread, f"id {kind}, cluster int, distance long"), "clustered")
    for name in names:  # the files lie in the shared folder until that is cleaned
        spark.sql(f"DROP TABLE {name}")
    return rows, centroids


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, prefix: str = "3:") -> DataFrame:
    """One row per vector: ``id_col``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``k`` vectors of smallest sha256 of ``prefix`` and the id.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, id_col, vec_col, width, scale), "integer-vectors")
    centroids = first_centroids(vectors, k, prefix)
    kind = vectors.schema["id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows, centroids = delta_lloyd(spark, vectors, centroids, rounds)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = own.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    per_cluster = named.join(own, "cluster").crossJoin(every)  # k rows at most
    got = rows.join(F.broadcast(per_cluster), "cluster")
    return got.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
