"""Exact deduplication with a two-pass Bloom filter.

Pass one marks, for each document, a few slots of a blocked Bloom filter and finds the slots that at least two rows
marked. Pass two holds each document against them: one with a slot that nobody else marked is alone and passes
straight through; only the others, possible repeats, shuffle and are grouped by their full digest, so that false
positives cost time and never change the result.

A block of the filter is 65,536 slots (8 KB); a document's slots all lie in one block. Tasks send the marked slots
(two bytes each) and not rows; the blocks are merged by a streaming pass over sorted rows, with one block in memory
(its marks are two bytes a slot and task, so a text found everywhere sends three slots a task). The slots found marked
twice go back to where they came from: each input file gets the list of its own (``in_place``), a few bytes a row,
and pass two looks them up while it reads the file. So no row is shuffled to learn whether it may repeat, no filter is
broadcast, and the path is the same at every size.

Defined results: a null text is an empty text; empty texts are equal to each other; an id that is null comes after all
others; rows that repeat the id of the row that stays count as that row in ``find_exact_duplicates`` (all are marked
as kept), while ``drop_exact_duplicates`` keeps exactly one row of each group; an empty table gives an empty result;
extra columns, whatever their names, are ignored by the first and kept by the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_groups, materialize, text_of
from .in_place import file_label, listed, packed, select_rows, store_keys

SLOTS = 1 << 16
PROBES = 3
FLUSH = 1 << 21


def _bare(text_col: str) -> Column:
    """The text without white space, in UTF-8."""
    return F.translate(text_of(text_col), SPACES, "").cast("binary")


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> (16 * k)) & 0xFFFF for k in range(PROBES)]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, block, h) of each row -> (label, block, slots marked, slots marked at least twice), a few rows for each block."""

    def flush(label: int, held: list[np.ndarray]) -> pa.RecordBatch:
        slots, times = np.unique(np.concatenate(held), return_counts=True)
        blocks, local = slots >> 16, (slots & 0xFFFF).astype(np.uint16)
        at = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        ends = np.r_[at[1:], len(slots)]
        once = [local[i:j].tobytes() for i, j in zip(at, ends)]
        twice = [local[i:j][times[i:j] > 1].tobytes() for i, j in zip(at, ends)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label), pa.int64()), pa.array(blocks[at], pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["label", "block", "once", "twice"])

    now, held, n = None, [], 0
    for batch in batches:
        label, block, h = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        cuts = np.r_[0, np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and (label[i] != now or n >= FLUSH):
                yield flush(now, held)
                held, n = [], 0
            now = int(label[i])
            held += [(block[i:j] << 16) | s for s in _slots(h[i:j])]
            n += PROBES * (j - i)
    if held:
        yield flush(now, held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> (label, keys): of each file, the cells (block and slot) that any two rows marked."""

    def done(block: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, bytes]]:
        once, twice, out = np.zeros(SLOTS, bool), np.zeros(SLOTS, bool), []
        for _, a, b in rows:
            twice[a[once[a]]] = True
            once[a] = True
            twice[b] = True
        for label, a, _ in rows:
            own = a[twice[a]].astype(np.int64)
            if len(own):
                out.append((label, packed((block << 16) | own, np.zeros(len(own), np.int64))))
        return out

    def batch_of(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        labels, keys = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(keys, pa.binary())], ["label", "keys"])

    now, rows, found = None, [], []
    for batch in batches:
        for label, block, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if block != now and rows:
                found += done(now, rows)
                rows = []
                if len(found) > 1000:
                    yield batch_of(found)
                    found = []
            now = block
            rows.append((label, np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)))
    if rows:
        found += done(now, rows)
    if found:
        yield batch_of(found)


class RepeatFilter:
    """The Bloom filter of the ``key`` column of a stored table: which of its rows may repeat another's key."""

    def __init__(self, stored: DataFrame, key: Column, rows: int, bits_per_key: int):
        self.blocks = max(1, -(-rows * bits_per_key // SLOTS))
        marks = stored.select(file_label().alias("label"), self._block(key).alias("block"), key.alias("h")).mapInArrow(_marks, "label long, block long, once binary, twice binary")
        cells = marks.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "label long, keys binary")
        self.folder = store_keys(cells, "repeat-filter")

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks).cast("long"))

    def rows(self, stored: DataFrame, key: Column, repeats: bool) -> DataFrame:
        """The rows that may repeat (all their cells are marked by at least two rows), or those that are alone."""
        folder = self.folder

        def decide() -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
            look = listed(folder)

            def pick(label: int, block: np.ndarray, h: np.ndarray) -> np.ndarray:
                none, maybe = np.zeros(len(h), np.int64), np.ones(len(h), bool)
                for s in _slots(h):
                    maybe &= look(label, (block << 16) | s, none)
                return maybe == repeats

            return pick

        return select_rows(stored, file_label(), self._block(key), key, decide)


def find_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_key: int = 16) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after white space is deleted. Of equal texts the longest original (in code
    points) stays, then the smallest id.
    """
    sha = F.unhex(F.sha2(_bare(text_col), 256))
    narrow = materialize(docs.select(F.col(f"`{id_col}`").alias("_id"), sha.alias("_sha"), F.length(text_of(text_col)).alias("_n")), "digests")
    n, key = narrow.count(), F.xxhash64("_sha")
    repeats = RepeatFilter(narrow, key, n, bits_per_key)
    maybe = repeats.rows(narrow, key, True)
    groups = maybe.groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("last"), F.col("_id").alias("id"))).alias("_best"))
    groups = materialize(groups.select("_sha", "_size", F.col("_best.id").alias("_keep")), "repeat-groups")
    grouped = join_groups(maybe, groups, ["_sha"], "_size", n).select("_id", "_keep", "_size", "_sha")
    alone = repeats.rows(narrow, key, False).select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), "_sha")
    return grouped.unionByName(alone).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_key: int = 16, stored: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts; the columns stay as they are.

    The row that stays is the one ``find_exact_duplicates`` names; among rows that repeat its id, any one of the
    least digest of all columns. Rows that cannot have a repeat do not shuffle. ``stored``: ``docs`` is a table as read
    from files; otherwise it is written to the shared folder first, as its rows are found again by file.
    """
    if not stored:
        docs = materialize(docs, "exact-dedup-input")
    key = F.xxhash64(_bare(text_col))
    repeats = RepeatFilter(docs, key, docs.count(), bits_per_key)
    maybe = repeats.rows(docs, key, True).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.sha2(_bare(text_col), 256).alias("_sha"), F.length(text_of(text_col)).alias("_n"))
    order = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.sha2(F.to_json("_row"), 256).alias("tie"))
    best = maybe.groupBy("_sha").agg(F.min_by("_row", order).alias("_row")).select("_row.*")
    return repeats.rows(docs, key, False).union(best)
