"""Links between texts by the similarity of their sets of word shingles: bands find pairs, the whole sets decide them.

For each distinct set of shingle hashes 100 least hashes are taken, in 20 bands of 5, and a byte of each is kept as a mark.
Sets that agree in a band share a bucket. Links are found in two steps:

1. Each bucket has a representative, the member that shares buckets with most others (the original of many edited copies
   agrees with all of them, a copy with few), and every member is held against it. So a page meets all its copies, and
   a group of like copies hangs together, with as many pairs as a bucket has members.
2. Members that are not connected by these links are held against each other, in the buckets where that is so. Their
   marks are compared in the task, in blocks of ``BLOCK`` members, and members that are alike in at least
   ``similarity`` - ``SLACK`` of them with one of another component meet again in the same blocks, with their whole sets.
   There the pairs are decided, and the links that connect components are sent, not the pairs. There is no cap on partners.

In both steps pairs whose sizes and marks allow the similarity are held against each other by their whole sets (Jaccard
similarity of 64-bit hashes). Only the texts in shared buckets are read again; in step 1 a set that many are held against is
sent once for every ``SENT`` of them.

Two texts of similarity 0.8 share no band with a probability of 0.0004 (0.9: 2e-8), and have too few like marks for step 2 with one of
0.002 (0.85: 5e-6), for step 1 with one of 2e-6. Step 2 compares marks of all pairs of unlinked members of a
bucket, so its time grows with the square of the number of such members (texts that share a passage and are no copies), and a
member is sent once for each block of its bucket; no row is made for a pair. A text's set takes eight bytes a shingle in the
task that holds it, and a task holds the sets of two blocks, of about ``ITEMS`` shingles each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, row_words, text_of, word_slices
from .components import connected_components
from .in_place import file_label, listed, pack_columns, stays, store_keys
from .memory import map_texts, release

SEED = 42
BANDS, DEPTH = 20, 5
#: Odd factors: each orders the hashes in another way.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
#: How far the share of like marks may lie below the similarity asked for, in each step.
WIDE, SLACK = 0.2, 0.12
#: Members of a bucket in one block and items of their sets, about, and partners that one copy of a set is sent to.
BLOCK, ITEMS, SENT = 512, 1 << 19, 512
#: A bucket with more than this part of all rows (one in ...) is large.
HEAVY = 1000
#: Bytes of a text cut into words at once.
SLICE = 1 << 19


def shingle_hashes(text: bytes, shingle: int, size: int = SLICE) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, slice by slice; A-Z are lower-cased. Fewer words: all of them."""
    tail, some = [], False
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for words in word_slices(text.lower(), size):
        own = tail + words
        tail = own[-(shingle - 1) :] if shingle > 1 else []
        if len(own) >= shingle:
            some = True
            yield np.fromiter((digest(join(s), SEED) for s in zip(*(own[k:] for k in range(shingle)))), np.uint64)
    if tail and not some:
        yield np.array([digest(join(tail), SEED)], np.uint64)


def shingle_set(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def name_of(items: np.ndarray) -> int:
    """A set's name: a 64-bit hash of its items."""
    return xxhash.xxh64_intdigest(items.tobytes(), SEED) if len(items) else 0


def least_hashes(items: np.ndarray) -> np.ndarray:
    """For each of ``FACTORS`` the least product with an item; none for an empty set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(items), 4096):
        least = np.minimum(least, (items[at : at + 4096, None] * FACTORS).min(0))
    return least if len(items) else least[:0]


def bands_of(items: np.ndarray, least: np.ndarray | None = None) -> bytes:
    """The hashes of the bands of a set, 8 bytes each; none for an empty set."""
    rows = (least_hashes(items) if least is None else least).reshape(-1, DEPTH)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).tobytes()


def marks_of(least: np.ndarray) -> bytes:
    """A byte of each least hash."""
    return ((least >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes()


def similarity_of(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def shared_buckets(entries: DataFrame) -> DataFrame:
    """(key, s, n, many, deg), written: the buckets that several sets share, with their sizes; ``deg`` is the sum of the
    sizes of all buckets that a set is in. ``entries``: (s, n, bands, marks), distinct in s."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(batch.column("n").to_numpy() > 0))
            keys = np.frombuffer(b"".join(x.as_py() for x in some.column("bands")), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(some.column(c).to_numpy(), BANDS)) for c in ("s", "n"))], ["key", "s", "n"])
        release()

    placed = materialize(entries.select("s", "n", "bands").mapInArrow(place, "key long, s long, n long"), "bands")
    counts = materialize(placed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared-bands")
    # Most rows are alone in their bucket: large buckets are told by a list of fewer than ``HEAVY`` keys, so no row but the shared ones leaves a join.
    large = counts.where(F.col("many") > placed.count() / HEAVY)
    keys = [r.key for r in large.select("key").collect()]
    of_large = F.col("key").isin(keys) if keys else F.lit(False)
    rest = placed.where(~of_large).join(counts, "key")
    shared = materialize(rest.unionByName(placed.where(of_large).join(F.broadcast(large), "key")) if keys else rest, "buckets")
    return materialize(shared.join(shared.groupBy("s").agg(F.sum("many").alias("deg")), "s"), "buckets-by-degree")


def representative_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(s, s2), distinct: each set and the representatives of its buckets, where their sizes allow the similarity."""
    first = materialize(shared.groupBy("key").agg(F.max(F.struct("deg", "s", "n")).alias("rep"), F.count(F.lit(1)).alias("many")), "representatives")
    held = join_groups(shared.drop("many", "deg"), first, ["key"], "many", shared.count())
    sizes = F.least("n", "rep.n") >= similarity * F.greatest("n", "rep.n")
    return held.where(sizes & (F.col("s") != F.col("rep.s"))).select("s", F.col("rep.s").alias("s2")).distinct()


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """(whether two blocks meet, its rows) for each group of sorted rows with key, i and j."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
            group = (key[a], i[a], j[a])
            if group != now and held:
                yield now[1] != now[2], pa.Table.from_batches(held)
                held = []
            now = group
            held.append(batch.slice(a, b - a))
    if held:
        yield now[1] != now[2], pa.Table.from_batches(held)


def alike_by_marks(t: pa.Table, both: bool, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(a member, the later members or those of the other block that differ in label and are of like size and marks)."""
    n, label, side = (t[c].to_numpy() for c in ("n", "label", "side"))
    marks = np.frombuffer(b"".join(x.as_py() for x in t["marks"]), np.uint8).reshape(len(n), -1)
    other, least = np.flatnonzero(side), (similarity - SLACK) * marks.shape[1]
    for at in np.flatnonzero(~side) if both else range(len(n)):
        to = other if both else np.arange(at + 1, len(n))
        to = to[(label[to] != label[at]) & (np.minimum(n[to], n[at]) >= similarity * np.maximum(n[to], n[at]))]
        to = to[(marks[to] == marks[at]).sum(1) >= least]
        if len(to):
            yield at, to


def unlinked_links(shared: DataFrame, labels: DataFrame, marks: DataFrame, sets: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """(s, s2), s < s2: links between members of one bucket that differ in ``labels`` (s, label), by their whole ``sets`` (s, items).

    They connect what all such links connect: of each group at most one link fewer than it has labels, however many pairs
    are alike. ``labels``: the component each set is in so far. Buckets with one label are done.
    """
    block, columns = block or BLOCK, ["key", "i", "j", "side", "s", "n", "label", "marks"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both, t in groups_of(batches):
            some = np.zeros(t.num_rows, bool)
            for at, to in alike_by_marks(t, both, similarity):
                some[at] = some[to] = True
            if some.any():
                yield from t.filter(pa.array(some)).select(columns).combine_chunks().to_batches()
        release()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both, t in groups_of(batches):
            s, n = t["s"].to_numpy(), t["n"].to_numpy()
            # Items by number, so that a set is held against others by flags.
            known, code = np.unique(np.frombuffer(b"".join(x.as_py() for x in t["items"]), np.uint64), return_inverse=True)
            own = np.split(code.astype(np.int32), n.cumsum()[:-1])
            flags = np.zeros(len(known), bool)
            _, part = np.unique(t["label"].to_numpy(), return_inverse=True)
            found = []
            for at, to in alike_by_marks(t, both, similarity):
                to = to[part[to] != part[at]]
                if not len(to):
                    continue
                flags[own[at]] = True
                common = np.add.reduceat(flags[np.concatenate([own[k] for k in to])], np.r_[0, n[to].cumsum()[:-1]], dtype=np.int64)
                flags[own[at]] = False
                for k in to[common / (n[to] + n[at] - common) >= similarity]:
                    if part[k] != part[at]:
                        part[part == part[k]] = part[at]
                        found.append((min(s[at], s[k]), max(s[at], s[k])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["s", "s2"])
        release()

    labelled = shared.select("key", "s", "n").join(labels, "s")
    open_ = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").drop("_a", "_b")
    rows = materialize(join_groups(materialize(labelled, "labelled"), materialize(open_, "open-buckets"), ["key"], "many", shared.count()), "open-members").join(marks, "s")
    # Members are dealt into k blocks, and each pair of blocks is a group; ``side``: whether a member is of the second block.
    k = F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("total") / ITEMS)).cast("int")
    own = F.pmod(F.xxhash64("s"), k).cast("int")
    groups = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).alias("side")))
    dealt = rows.select("key", "s", "n", "label", "marks", F.explode(groups).alias("g")).select("key", "g.i", "g.j", "g.side", "s", "n", "label", "marks")
    in_groups = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in columns)
    # Sets are sent to the groups where they have a partner by marks.
    wanted = materialize(in_groups(dealt).mapInArrow(candidates, kinds), "unlinked-members")
    return map_texts(in_groups(wanted.join(sets, "s")), links, "s long, s2 long")


def like_marks(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose marks allow the similarity. ``s2`` may be the partner of many."""
    least = (similarity - WIDE) * len(FACTORS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(m.as_py() for m in batch.column(c)), np.uint8).reshape(batch.num_rows, -1) for c in ("marks", "marks2"))
                yield batch.select(["s", "s2"]).filter(pa.array((x == y).sum(1) >= least))
        release()

    return beside(pairs, marks.toDF("s2", "marks2")).join(marks, "s").select("s", "s2", "marks", "marks2").mapInArrow(keep, "s long, s2 long")


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (written) joined with ``values`` by s2, which many pairs may share: its value is sent once for each ``SENT`` of them."""
    many = materialize(pairs.groupBy("s2").agg(F.count(F.lit(1)).alias("_many")), "partners")
    parts = F.ceil(F.col("_many") / SENT).cast("int")
    dealt = join_groups(pairs, many, ["s2"], "_many", pairs.count()).withColumn("_part", F.pmod(F.xxhash64("s"), parts).cast("int")).drop("_many")
    sent = values.join(many, "s2").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_many")
    return dealt.join(sent, ["s2", "_part"]).drop("_part")


def set_links(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(u, v), u < v: fingerprints of texts whose sets of shingles have at least this Jaccard similarity, or that are linked
    through others by it.

    ``docs``: a stored table. ``rows``: a written table (label, a, b, fp, s, n, bands, marks) of its rows.
    """
    entries = materialize(rows.groupBy("s").agg(F.min(F.struct("label", "a", "b")).alias("at"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "sets")
    shared = shared_buckets(entries)
    marks = entries.where("n > 0").select("s", "marks")
    places = shared.select("s").distinct().join(entries, "s").select("at.label", "at.a", "at.b")
    folder = store_keys(pack_columns(places), "texts-wanted")
    texts = docs.select(file_label().alias("label"), *row_words(docs), text_of(text_col).cast("binary").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Picked and cut in one task: two in a row would be two processes beside each task.
        pick = listed(folder)
        for batch in batches:
            stay = stays(pick, *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            for at in np.flatnonzero(stay):
                text = batch.column(3)[int(at)]
                items = shingle_set(list(shingle_hashes(text.as_py(), shingle)))
                yield pa.RecordBatch.from_arrays([pa.array([name_of(items)], pa.uint64()).view(pa.int64()), pa.array([items.tobytes()], pa.binary())], ["s", "items"])
        release()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("items"), batch.column("items2")
            near = [similarity_of(*(np.frombuffer(c[k].as_py(), np.uint64) for c in (x, y))) >= similarity for k in range(len(x))]
            yield batch.select(["s", "s2"]).filter(pa.array(near, pa.bool_()))
        release()

    # Rows equal in all columns give one set more than once.
    sets = materialize(map_texts(texts, whole, "s long, items binary").groupBy("s").agg(F.first("items").alias("items")), "whole-sets")

    nearby = like_marks(materialize(representative_pairs(shared, similarity), "representative-pairs"), marks, similarity)
    pairs = materialize(nearby, "first-pairs")
    held = beside(pairs, sets.toDF("s2", "items2")).join(sets, "s").select("s", "s2", "items", "items2")
    to_first = materialize(map_texts(held, decide, "s long, s2 long"), "first-links")
    roots = connected_components(to_first.select(F.col("s").alias("u"), F.col("s2").alias("v")))
    labels = shared.select("s").distinct().join(roots, F.col("s") == F.col("node"), "left").select("s", F.coalesce("root", "s").alias("label"))
    labels = materialize(labels, "labels")
    others = materialize(unlinked_links(shared, labels, marks, sets, similarity), "more-links")
    names = entries.select("s", "fp")
    edges = beside(to_first.unionByName(others), names.toDF("s2", "v")).join(names.toDF("s", "u"), "s").select("u", "v")
    # Texts of one set may have several fingerprints.
    same = rows.select("s", "fp").distinct().join(names.toDF("s", "v"), "s").select(F.col("fp").alias("u"), "v")
    return edges.unionByName(same).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
