"""Nearest neighbours by inner product over shifted Hilbert curves.

Candidates are split by norm into ranges of powers of two below the largest (at most ``ranges``, the rest in the last), and
each range is searched on its own, by curves, bounds and a largest norm of its own (neighbouring ranges that hold no more than
``curves`` x ``least`` vectors together are one). So a few long vectors leave the order of the others as it is. Within a range
largest inner product becomes nearest point by one more coordinate (candidates are divided by the range's largest norm and
get the coordinate that makes them unit vectors; queries are divided by their own norm and get 0). For each of
``curves`` curves, points are projected onto ``dims`` random orthonormal directions, shifted, cut into 2**(2 ``bits``) steps
per direction (bounds: from at most ``sample`` candidates and as many queries) and ordered along a Hilbert curve, whose place is two words; points
of one cell are ordered by a projection of the curve's own, and what is equal there too by a hash of the curve's own, so
that no two curves give a tight cluster the same windows. Spark range-partitions the orderings; a point's rank follows
from the partitions' counts. A curve is cut into blocks of equal size, and a query is
held against its own block and its neighbours, so that its window is a fixed share of all rows (3 / ``blocks`` per curve,
and at least ``least`` candidates to a block, if there are no more than three queries to each), whatever the number of rows or of equal vectors. Windows' best are merged over all
curves and ranked by exact inner products in double precision.

Each distinct vector is indexed once, with the k + 1 smallest ids that have it, and asked once; ids are put in after the
search, so that copies take no room in windows and are exact among each other. Every vector is indexed. The directions near a query's neighbours are few where vectors have structure; on vectors
without any, in 64 dimensions, recall of 0.9 takes most of the pairs, however they are ordered (README).

Defined results: vectors that are null, zero, of another length than most_common_length's or hold null or non-finite
parts take no part, nor do null ids; rows that repeat an id with another vector are candidates each; equal scores go to
the smaller id; fewer candidates than k give all of them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, parts_for


def hilbert_words(cells: np.ndarray, bits: int, words: int) -> list[np.ndarray]:
    """Place along the Hilbert curve of each row of ``cells``: (n, dims) integers below 2**(bits * words).

    The place is ``words`` integers, the first from the top ``bits`` bit planes; dims * bits <= 63.

    Works from the top bit plane down: Gray-decodes the plane's corner and undoes the rotation and reflection that
    the curve has there.
    """
    n, dims = cells.shape
    cells = cells.astype(np.int64)
    entry, turn = np.zeros(n, np.int64), np.zeros(n, np.int64)
    key, mask = np.zeros(n, np.int64), (1 << dims) - 1
    rotate = lambda x, k: ((x >> k) | (x << (dims - k))) & mask
    low_ones = np.zeros(mask + 1, np.int64)
    for k in range(1, dims + 1):
        low_ones[((np.arange(mask + 1) + 1) & ((1 << k) - 1)) == 0] = k
    found = []
    for plane in range(bits * words - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for d in range(dims):
            corner |= ((cells[:, d] >> plane) & 1) << d
        gray = rotate(corner ^ entry, (turn + 1) % dims)
        at = gray.copy()
        step = 1
        while step < dims:
            at ^= at >> step
            step <<= 1
        key = (key << dims) | at
        # The entry point and direction of sub-cube ``at`` of a Gray-code walk.
        even = np.where(at > 0, (at - 1) & ~1, 0)
        start = np.where(at > 0, even ^ (even >> 1), 0)
        way = np.where(at == 0, 0, np.where(at & 1, low_ones[at], low_ones[np.maximum(at - 1, 0)])) % dims
        entry ^= rotate(start, (dims - (turn + 1)) % dims)
        turn = (turn + way + 1) % dims
        if plane % bits == 0:
            found.append(key)
            key = np.zeros(n, np.int64)
    return found


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place as one integer: (n, dims) integers below 2**bits; dims * bits <= 63."""
    return hilbert_words(cells, bits, 1)[0]


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each id that differs by ``salt``."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt + 1) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>): the rows that take part."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return good.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def norm_ranges(counts: dict[int, int], small: int, most: int) -> list[tuple[int, int]]:
    """(last power, vectors) of each range, longest vectors first.

    ``counts``: vectors by the number of halvings below the largest norm. Powers are put together as long as they hold
    at most ``small`` vectors; the last of ``most`` ranges takes all the rest.
    """
    found: list[tuple[int, int]] = []
    for power in sorted(counts):
        if found and (found[-1][1] + counts[power] <= small or len(found) == most):
            found[-1] = (power, found[-1][1] + counts[power])
        else:
            found.append((power, counts[power]))
    return found


def distinct_vectors(rows: DataFrame, width: int, most: int, salts: int = 64) -> DataFrame:
    """(node, h1, h2, vec, ids, norm), written: each vector (of ``width`` parts) once with its ``most`` smallest ids.

    A vector's rows are dealt by a hash of the id first, so that no task takes all copies of one vector.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), width)
            # Scaled by the largest part first, so that squares neither overflow nor vanish.
            part = np.abs(x).max(1, keepdims=True)
            norm = part[:, 0] * np.sqrt(((x / part) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], [*batch.schema.names, "norm"])

    place = Window.partitionBy("h1", "h2", "_salt").orderBy("id")
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= most)
    some = few.groupBy("h1", "h2", "_salt").agg(F.first("vec").alias("vec"), F.collect_list("id").alias("ids"))
    whole = some.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))
    return materialize(whole.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "vec", "ids").mapInArrow(measure, "node long, h1 long, h2 long, vec array<double>, ids array<long>, norm double"), "distinct-vectors")


def distinct_questions(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that ask, (id, h1, h2, own), and what they ask, written: (node, h1, h2, own, n, vec).

    ``own``: empty, or the id where it has other vectors too, all of which its question must leave out.
    """
    several = materialize(rows.groupBy("id").count().where("count > 1").select("id", F.col("id").cast("string").alias("own")), "repeated-ids")
    asking = rows.where("asked").select("id", "h1", "h2").join(several, "id", "left").withColumn("own", F.coalesce("own", F.lit("")))
    asking = materialize(asking, "asking")
    each = asking.groupBy("h1", "h2", "own").agg(F.count(F.lit(1)).alias("n")).join(nodes.select("h1", "h2", "vec"), ["h1", "h2"])
    return asking, materialize(each.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "own", "n", "vec"), "questions")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = 28, dims: int = 8, bits: int = 7, blocks: int = 75, least: int = 256, most_block: int = 8192, sample: int = 10_000, ranges: int = 8, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found of each row where ``is_query`` (of ``id``)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id", "vec"])
    rows = materialize(rows.select("id", "vec", is_query.alias("asked"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(k), F.reverse("vec")).alias("h2")), "vectors")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = common["d"]
    rows = rows.where(F.size("vec") == width)
    nodes = distinct_vectors(rows, width, k + 1)
    asking, questions = distinct_questions(rows, nodes)
    n_queries = questions.count()
    top = nodes.agg(F.max("norm")).first()[0]
    power = F.floor(F.log2(F.lit(top)) - F.log2("norm") + 1e-9).cast("int")
    split = norm_ranges(dict(nodes.groupBy(power.alias("power")).count().collect()), curves * least, ranges)  # a row per power of two
    where = F.lit(len(split) - 1)
    for r in range(len(split) - 2, -1, -1):
        where = F.when(power <= split[r][0], r).otherwise(where)
    nodes = materialize(nodes.withColumn("range", where.cast("int")), "norm-ranges")
    largest = dict(nodes.groupBy("range").agg(F.max("norm")).collect())
    curved = list(range(len(split)))

    rng = np.random.default_rng(seed)
    dims = min(dims, width + 1)
    turns = [np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0] for _ in range(curves)]
    axes, aside = np.stack([t[:, :dims] for t in turns]), np.stack([t @ rng.normal(size=width + 1) for t in turns])
    shifts = rng.random((curves, dims))

    def points(x: np.ndarray, r: int | None) -> np.ndarray:
        """On the unit sphere: candidates of range ``r``, or queries (None)."""
        part = np.abs(x).max(1, keepdims=True)
        size = part[:, 0] * np.sqrt(((x / part) ** 2).sum(1))
        own = x / (size[:, None] if r is None else largest[r])
        more = np.zeros(len(x)) if r is None else np.sqrt(np.maximum(0, 1 - (size / largest[r]) ** 2))
        return np.c_[own, more]

    def some(df: DataFrame, r: int | None) -> np.ndarray:
        chosen = df.orderBy(F.xxhash64("h1", F.lit(seed)), "h1", "h2").limit(max(1, sample // len(curved))).select("vec").collect()
        return np.einsum("nd,cdk->cnk", points(np.array([x.vec for x in chosen]).reshape(-1, width), r), axes)

    low, reach = {}, {}
    asked = some(questions, None) if n_queries else None
    for r in curved:
        bounds = [np.quantile(y, [0.001, 0.999], axis=1) for y in (some(nodes.where(F.col("range") == r), r), asked) if y is not None]
        low[r], high = np.min([b[0] for b in bounds], axis=0), np.max([b[1] for b in bounds], axis=0)
        reach[r] = np.maximum(high - low[r], 1e-12)
    steps = 1 << (2 * bits)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, of = batch.column(0).to_numpy(), _matrix(batch.column(1), width), batch.column(2).to_numpy()
            for r in curved:
                for query in (False, True):
                    keep = of == (-1 if query else r)
                    if keep.any():
                        own, at = ids[keep], points(x[keep], None if query else r)
                        for c in range(curves):
                            # Half of the cube holds the points, the shift moves them within it.
                            y = ((at @ axes[c] - low[r][c]) / reach[r][c] + shifts[c]) / 2
                            key, fine = hilbert_words(np.clip(y * steps, 0, steps - 1).astype(np.int64), bits, 2)
                            places = [np.full(len(own), r * curves + c, np.int32), key, fine, at @ aside[c], mixed(own, 2 * c + query), own, np.full(len(own), query)]
                            yield pa.RecordBatch.from_arrays([pa.array(p) for p in places], [*along, "id", "query"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))], ["curve", "id", "query", "part", "at"])
            at += batch.num_rows

    none = F.array().cast("array<long>")
    # ``range`` is -1 for queries, which meet all ranges.
    items = nodes.select("node", "vec", "range", F.lit("").alias("own"), "ids")
    items = items.unionByName(questions.select("node", "vec", F.lit(-1).alias("range"), "own", none.alias("ids")))
    along = ["curve", "key", "fine", "side", "mixed"]
    entries = {r: split[r][1] + n_queries for r in curved}  # on each curve of the range
    keyed = items.select("node", "vec", "range").mapInArrow(order, "curve int, key long, fine long, side double, mixed long, id long, query boolean")
    keyed = keyed.repartitionByRange(parts_for(curves * sum(entries.values()), 500_000, 8), *along).sortWithinPartitions(*along).select("curve", "id", "query")
    ordered = materialize(keyed.mapInArrow(number, "curve int, id long, query boolean, part int, at long"), "curve-order")
    counts = dict(ordered.groupBy("part").count().collect())  # one number per partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    starts = spark.createDataFrame(sorted(before.items()), "part int, before long")
    size, wide, last, first = {}, {}, {}, {}
    gone = 0
    for r, many in entries.items():
        # Queries lie among the candidates: a block has ``least`` of these on average, up to three queries to each.
        share = max(round(least * min(4, many / (many - n_queries))), -(-many // blocks))
        size[r] = min(share, most_block)
        wide[r], last[r], first[r] = -(-share // size[r]), (many - 1) // size[r], gone
        gone += curves * many
    block = F.lit(0).cast("long")
    for r, many in entries.items():
        own = F.floor((F.col("before") + F.col("at") - first[r] - (F.col("curve") - r * curves).cast("long") * many) / size[r])
        block = F.when(F.floor(F.col("curve") / curves) == r, own).otherwise(block)
    placed = ordered.join(F.broadcast(starts), "part").select(F.col("id").alias("node"), "query", F.struct("curve", block.alias("block")).alias("place"))
    places = placed.groupBy("node", "query").agg(F.collect_list("place").alias("places"))  # one on each curve
    places = places.select(F.col("node").alias("_node"), F.col("query").alias("_query"), "places")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2).to_numpy()
            places = batch.column(5)

            def send(row: np.ndarray, curve: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
                for lo in range(0, len(row), 4096):
                    i = row[lo : lo + 4096]
                    take = pa.array(i)
                    columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(of[i] < 0), batch.column(3).take(take), batch.column(4).take(take)]
                    yield pa.RecordBatch.from_arrays([pa.array(curve[lo : lo + 4096]), pa.array(to[lo : lo + 4096]), *columns], ["curve", "block", "node", "vec", "query", "own", "ids"])

            curve, own = (x.to_numpy(zero_copy_only=False) for x in places.flatten().flatten())
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
            for r in curved:
                mine = curve // curves == r
                for step in range(-wide[r], wide[r] + 1):
                    to = own + step
                    keep = np.flatnonzero(mine & (to >= 0) & (to <= last[r]) & ((of[row] < 0) | (step == 0)))
                    yield from send(row[keep], curve[keep], to[keep])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            asked, node = t["query"].to_numpy(), t["node"].to_numpy()
            x = _matrix(t["vec"].chunk(0), width)
            q, qid, c = x[asked], node[asked], x[~asked]
            leave = t["own"].filter(pa.array(asked)).to_pylist()
            ids = t["ids"].filter(pa.array(~asked)).combine_chunks()
            many, ids = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            start = np.cumsum(many) - many
            for lo in range(0, len(q) if len(c) else 0, 512):
                own, oid = q[lo : lo + 512], qid[lo : lo + 512]
                near = own @ c.T
                without = {i: int(o) for i, o in enumerate(leave[lo : lo + 512]) if o}
                for i, o in without.items():
                    near[i, (many == 1) & (ids[start] == o)] = -np.inf
                kth = np.partition(near, -k - 1, axis=1)[:, -k - 1] if len(c) > k + 1 else np.full(len(own), -np.inf)
                # Products rounded in another order differ by far less than this slack; the rest is exact.
                slack = 1e-9 * np.maximum(1, np.abs(kth)) if len(c) > k + 1 else 0
                i, j = np.nonzero((near >= (kth - slack)[:, None]) & (near > -np.inf))
                score = (own[i] * c[j]).sum(1)
                o = np.lexsort((ids[start[j]], -score, i))
                i, j, score = i[o], j[o], score[o]
                # One more than k vectors, and of their ids one more than k: a question's own id is taken out later.
                top = np.arange(len(i)) - np.searchsorted(i, i) <= k
                i, j, score = i[top], j[top], score[top]
                of = np.repeat(np.arange(len(i)), many[j])
                hit = ids[start[j][of] + np.arange(len(of)) - np.repeat(np.cumsum(many[j]) - many[j], many[j])]
                i, score = i[of], score[of]
                if without:
                    stay = hit != np.array([without.get(a, -1) for a in range(len(own))])[i]
                    stay |= ~np.isin(i, list(without))
                    i, score, hit = i[stay], score[stay], hit[stay]
                o = np.lexsort((hit, -score, i))
                i, score, hit = i[o], score[o], hit[o]
                top = np.arange(len(i)) - np.searchsorted(i, i) <= k
                yield pa.RecordBatch.from_arrays([pa.array(oid[i[top]]), pa.array(hit[top]), pa.array(score[top])], ["node", "vec_id", "score"])

        held, now = [], None
        for batch in batches:
            curve, blk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (blk[1:] != blk[:-1])) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(curve)]):
                key = (curve[i], blk[i])
                if key != now and held:
                    yield from best(held)
                    held = []
                now = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from best(held)

    with_places = items.join(places, (F.col("node") == F.col("_node")) & ((F.col("range") < 0) == F.col("_query"))).select("node", "vec", "range", "own", "ids", "places")
    dealt = with_places.mapInArrow(deal, "curve int, block long, node long, vec array<double>, query boolean, own string, ids array<long>")
    groups = parts_for(sum(curves * (last[r] + 1) for r in last), 64, 8)
    found = dealt.repartition(groups, "curve", "block").sortWithinPartitions("curve", "block").mapInArrow(search, "node long, vec_id long, score double")
    # At most ranges x curves x (2 x wide + 1) x (k + 1) rows per question, whatever the number of rows.
    hits = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("vec_id"))))
    best = found.groupBy("node").agg(F.slice(hits, 1, k + 1).alias("_best")).join(questions.select("node", "h1", "h2", "own", "n"), "node").drop("node")
    each = join_groups(asking, materialize(best, "answers"), ["h1", "h2", "own"], "n", asking.count())
    each = each.select(F.col("id").alias("query_id"), F.filter("_best", lambda x: x["vec_id"] != F.col("id")).alias("_best"))
    once = each.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_best")))), 1, k).alias("_best"))
    return once.select("query_id", F.posexplode("_best").alias("_at", "_hit")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), (-F.col("_hit.less")).alias("score"))
