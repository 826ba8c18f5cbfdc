"""SimHash near-duplicates by segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two, and each segment is mapped to its number of one bits. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so all links of at most
three bits lie within Manhattan distance three. The vector's two halves (16 segments each) are grids: of a link,
one half must lie within distance one, so each fingerprint is placed in its own cell of either grid and, as a probe,
in the cells one step up (at most 16); the pair that is one step apart then meets in the cell of its upper member. Pairs that
meet are held against the Manhattan bound over all segments, and those left are verified exactly. Two fingerprints of
random bits share a cell of a grid once in six million times.

Only distinct fingerprints take part. Cells are streamed from sorted partitions; a cell sends a spanning forest of its
links and not all pairs, which joins the same fingerprints. Cells of more than ``block`` members are split: members and
probes are dealt into blocks, and each pair of blocks is a group of its own.

Components are found by alternating large and small stars over the forests' edges, written to the shared folder in
each round; nothing of them goes to the driver but the number of edges that changed.

Defined results: a null text is empty; texts without words have fingerprint zero, linked like any other; rows with a
null id get the component of their fingerprint (null if it has no other id); rows that repeat an id are judged by the
fingerprint each has; an empty table gives an empty result; extra columns are ignored by ``simhash_components`` and kept by
``drop_near_duplicates``, which leaves the row of the smallest id (null last, then the least hash of all columns) and, of
rows equal in all columns, one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, row_words, text_of
from .components import connected_components
from .in_place import file_label, listed, pack_columns, select_rows, store_keys
from .memory import map_texts, release
from .shingle_sets import bands_of, least_hashes, marks_of, name_of, set_links, shingle_hashes, shingle_set

HALF = 16
#: Number of one bits of the bytes.
POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)
#: Bytes of a text cut into words at once.
SLICE = 1 << 19


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """SimHash of 64-bit hashes, repeats included; zero of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the XXH64 values of the text's word shingles, repeats included; A-Z are lower-cased."""
    return fingerprint_of(shingle_hashes(text, shingle, SLICE))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, *others: Column, sets: bool = False) -> DataFrame:
    """(id, ..., fp): the fingerprint as a signed 64-bit integer, and ``others`` under their names.

    ``sets``: also s, n, bands and marks: the name, size, bands and marks of the set of shingles.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).cast("binary").alias("text"), *others)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            named, sizes, bands, marks = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), [], []
            for k, text in enumerate(batch.column(1)):
                if not sets:
                    fps[k] = fingerprint(text.as_py(), shingle)
                    continue
                hashes = list(shingle_hashes(text.as_py(), shingle, SLICE))
                items = shingle_set(hashes)
                fps[k], named[k], sizes[k] = fingerprint_of(hashes), name_of(items), len(items)
                least = least_hashes(items)
                bands.append(bands_of(items, least))
                marks.append(marks_of(least))
            more = [pa.array(named.view(np.int64)), pa.array(sizes), pa.array(bands, pa.binary()), pa.array(marks, pa.binary())] if sets else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps.view(np.int64)), *more], [*names, "fp", *(["s", "n", "bands", "marks"] if sets else [])])
        release()

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]
    return map_texts(rows, run, ", ".join([*kinds, "fp long", *(["s long", "n long", "bands binary", "marks binary"] if sets else [])]))


def segment_counts(fp: np.ndarray, half: int) -> np.ndarray:
    """(n, HALF): one bits of the two-bit segments of one half of each fingerprint."""
    shifts = np.arange(HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(32 * half)
    pairs = (fp[:, None] >> shifts) & np.uint64(3)
    return ((pairs & np.uint64(1)) + (pairs >> np.uint64(1))).astype(np.int8)


def _forest(fp: np.ndarray, own: np.ndarray, most: int, across: bool = False, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group: pairs of places. ``own``: members of the cell, the rest are probes.

    Links among probes only are left out; they meet in other cells. ``across``: those among members are left out too.
    """
    n = len(fp)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # The Manhattan bound is held before the exact distance.
    counts = np.concatenate([segment_counts(fp, half) for half in range(2)], 1)
    members = np.flatnonzero(own)
    left, right = [], []
    for at in range(0, len(members), step):
        a = members[at : at + step]
        for to in range(0, n, step):
            b = np.arange(to, min(to + step, n))
            bound = np.zeros((len(a), len(b)), np.int8)
            for k in range(2 * HALF):
                bound += np.abs(counts[a, k][:, None] - counts[b, k][None, :])
            i, j = np.nonzero(bound <= most)
            i, j = a[i], b[j]
            keep = i != j
            keep &= ~own[j] if across else ~own[j] | (i < j)
            i, j = i[keep], j[keep]
            x = fp[i] ^ fp[j]
            near = POPCOUNT[x.view(np.uint8).reshape(-1, 8)].sum(1) <= most
            for p, q in zip(i[near].tolist(), j[near].tolist()):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    left.append(p)
                    right.append(q)
    return np.array(left, np.int64), np.array(right, np.int64)


def near_links(nodes: DataFrame, most: int = 3, block: int = 4096) -> DataFrame:
    """(u, v), u < v: links that join the same fingerprints as all links of at most ``most`` (3 or fewer) bits do.

    ``nodes``: (fp), distinct. The grids cover no wider links, so those are refused.
    """
    if most > 3:
        raise ValueError(f"the grids cover links of at most 3 bits, not {most}")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0)
            for half in range(2):
                counts = segment_counts(fp.to_numpy().view(np.uint64), half).astype(np.int64)
                cell = half + sum(counts[:, k] << (1 + 2 * k) for k in range(HALF))
                for k in range(-1, HALF):
                    real = np.ones(len(fp), bool) if k < 0 else counts[:, k] < 2
                    to = cell if k < 0 else cell + (1 << (1 + 2 * k))
                    yield pa.RecordBatch.from_arrays([pa.array(to[real]), pa.array(np.full(real.sum(), k < 0)), fp.filter(pa.array(real))], ["cell", "own", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def group(fp: np.ndarray, own: np.ndarray, part: int) -> None:
            i, j = _forest(fp.view(np.uint64), own, most, part < 0)
            if len(i):
                out.append((np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])))

        def close(held: list[tuple]) -> None:
            fp, own = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            if len(fp) > 1 and own.any():
                group(fp, own, key[1])

        def sent() -> pa.RecordBatch:
            u, v = (np.concatenate([x[k] for x in out]) for k in range(2))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held, key = [], None
        for batch in batches:
            cell, part, own, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "own", "fp"))
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[starts[1:], len(cell)]
            # The first run may go on with what is held, the last is held; of those between, most are one row alone.
            if held and (cell[0], part[0]) != key:
                close(held)
                held = []
            first = 0
            if held:
                held.append((fp[: ends[0]], own[: ends[0]]))
                first = 1
                if len(starts) > 1:
                    close(held)
                    held = []
            if first < len(starts):
                some = np.logical_or.reduceat(own, starts)
                for r in np.flatnonzero((ends - starts > 1) & some):
                    if first <= r < len(starts) - 1:
                        group(fp[starts[r] : ends[r]], own[starts[r] : ends[r]], part[starts[r]])
                held, key = [(fp[starts[-1] :], own[starts[-1] :])], (cell[-1], part[-1])
            if len(out) > 1000:
                yield sent()
        if held:
            close(held)
        if out:
            yield sent()
        release()

    placed = nodes.select("fp").mapInArrow(place, "cell long, own boolean, fp long")
    # The members of a cell of more than ``block`` are dealt into k blocks, its probes into 8 k: one group for each pair of
    # blocks of members, and one (numbered below 0) for each pair of a block of members and one of probes.
    sizes = materialize(placed.where("own").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumn("k", F.ceil(F.col("n") / block).cast("int")).drop("n"), "large-cells")
    known = placed.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    k, n_probes = F.col("k"), 8 * F.col("k")
    at, probe = F.pmod(F.xxhash64("fp"), k).cast("int"), F.pmod(F.xxhash64("fp"), n_probes).cast("int")
    group = lambda part, own: F.struct(part.cast("int").alias("part"), own.alias("own"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    members = F.transform(upto(k), lambda j: group(F.least(at, j) * k + F.greatest(at, j), at <= j))
    groups = (
        F.when(k == 1, F.array(group(F.lit(0), F.col("own"))))
        .when(F.col("own"), F.concat(members, F.transform(upto(n_probes), lambda j: group(-1 - (at * n_probes + j), F.lit(True)))))
        .otherwise(F.transform(upto(k), lambda j: group(-1 - (j * n_probes + probe), F.lit(False))))
    )
    dealt = known.select("cell", F.explode(groups).alias("g"), "fp").select("cell", "g.part", "g.own", "fp")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(links, "u long, v long")


def fingerprint_components(nodes: DataFrame, most: int, block: int, others: DataFrame | None = None) -> DataFrame:
    """``nodes`` (fp, ...; a written table, fp distinct) and root, the smallest fingerprint reachable, over ``others`` (u, v) too."""
    links = near_links(nodes, most, block)
    roots = connected_components(links if others is None else links.unionByName(others))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, block: int = 4096) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    found = materialize(fingerprint_components(nodes, most, block), "roots")
    names = found.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total = rows.count()
    named = materialize(join_groups(found, materialize(names, "components"), ["root"], "members", total).select("fp", "n", "component_id"), "named")
    return join_groups(rows, named, ["fp"], "n", total).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _listed_rows(folder: str, listed_stay: bool) -> Callable:
    """A decision for ``select_rows``: the rows in the files' lists, or those that are not."""

    def decide() -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        look = listed(folder)
        return lambda label, a, b: look(label, a, b) == listed_stay

    return decide


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` (a stored table) with one row of each group; the columns stay as they are.

    ``rows``: a written table (label, a, b, id, group) that has each row of ``docs`` by its file and both words of its hash. The
    row of the smallest id stays (null last, then the least hash). Rows are picked where they lie; only those that stay
    but are equal in all columns to another row shuffle, so that one of them is left.
    """
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "a", "b")
    best = materialize(rows.groupBy("group").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), "group-best")
    total = rows.count()
    ranked = join_groups(rows, best, ["group"], "n", total)
    chosen = (F.col("a") == F.col("best.a")) & (F.col("b") == F.col("best.b"))
    marked = materialize(ranked.select("label", "a", "b", chosen.alias("chosen")), "near-marks")
    # Rows equal in all columns are told apart by nothing: counted by hash, they leave the files and one comes back.
    many = materialize(marked.where("chosen").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("labels")).where("n > 1"), "equal-rows")
    again = many.select(F.explode("labels").alias("label"), "a", "b")
    gone = marked.where("NOT chosen").select("label", "a", "b").unionByName(again)
    words = row_words(docs)
    left = select_rows(docs, file_label(), *words, _listed_rows(store_keys(pack_columns(gone), "rows-gone"), False))
    if many.count() == 0:
        return left
    back = select_rows(docs, file_label(), *words, _listed_rows(store_keys(pack_columns(again), "rows-again"), True))
    a, b = row_words(back)
    one = back.select(F.struct(*[F.col(f"`{c}`") for c in back.columns]).alias("_row"), a.alias("_a"), b.alias("_b")).groupBy("_a", "_b").agg(F.first("_row").alias("_row"))
    return left.union(one.select("_row.*"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, block: int = 4096, stored: bool = False, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each component; columns as they are. Texts don't shuffle.

    ``similarity``: texts whose sets of shingles have at least this Jaccard similarity are linked too (``shingle_sets.py``), as
    fingerprints that are ``most`` bits apart find few of them at 0.8. Hashes of shingles shuffle for texts that have a
    partner to be held against. ``stored``: ``docs`` is a table as read from files; otherwise it is written to the shared
    folder first, as its rows are found again by file.
    """
    if not stored:
        docs = materialize(docs, "near-dedup-input")
    a, b = row_words(docs)
    places = (file_label().alias("label"), a.alias("a"), b.alias("b"))
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, *places, sets=similarity is not None), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "nodes")
    others = None if similarity is None else set_links(docs, rows, text_col, shingle, similarity)
    found = materialize(fingerprint_components(nodes, most, block, others), "roots")
    narrow = rows.select("label", "a", "b", "id", "fp")
    grouped = materialize(join_groups(narrow, found, ["fp"], "n", rows.count()).select("label", "a", "b", "id", F.col("root").alias("group")), "near-groups")
    return one_of_each(docs, grouped)
