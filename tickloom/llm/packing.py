"""Sum-of-squares packing of tokenized documents into sequences of fixed length.

Documents are tokenized where they lie; a document longer than a sequence is cut into full pieces, of which the first
may be shorter. Pieces of full length are sequences of their own. The others are dealt out evenly, sorted by falling
length, and each task places them one by one: of all open gaps that fit (and a new sequence), the one after which the
sum over all gaps of the squared number of open sequences with that gap is smallest. Tasks hold lengths, not texts or tokens.

A task takes about ``shard`` lengths, in every round. What lies in sequences that are not full is taken out and packed
again, first in the task, then dealt out anew over as many tasks as its number asks for, as long as that saves more than a
thousandth of the sequences that are not full.

A text's tokens are made slice by slice, so a task holds the ids of one text (4 bytes each) but not its words; texts with
runs of white space or special tokens are the exception, as their tokenizer takes them whole.

Defined results: a null text is empty, a single end token; ties between gaps go to the smaller gap and a new sequence
comes last; rows that repeat an id are packed each for itself; a null id is kept as it is; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts_for, text_of
from .memory import map_texts, release

#: Places where a text may not be cut before a space: white space, a space, and no word after it.
RUN = re.compile(r"\s (?!\S)")
#: How byte-level vocabularies of this kind split texts into words; a fixed value of the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters cut into words at once, up to the next space.
SLICE = 1 << 18
#: Bits of a sequence id for the sequence's number in its task, and for the task's number; the rest are the round's.
BIN_BITS, TASK_BITS = 26, 31
#: Words a process remembers (of about 150 bytes each) before it starts anew.
CACHE = 250_000


class WordTokenizer:
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit integers.

    The vocabulary's splitter never joins what stands before a space with a space and a word after it, so a text is
    cut there and each word tokenized once; the ids of words seen before are remembered. New words go through tiktoken
    with the vocabulary's own ranks, which gives the ids of ``tokenizers`` at a sixth of its time; texts with runs of
    white space or special tokens go through ``tokenizers`` whole, as all texts do in ``whole``.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = list(added)
        # Byte-level vocabularies spell a byte as the character of that number if it is printable, else as the next from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(spelled[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.words = Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}  # by word, with the space before it

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if RUN.search(text) or any(s in text for s in self.special):
            return self.whole([text])[0]
        parts, at = [], 0
        while True:
            to = text.find(" ", at + SLICE)
            parts.append(self._words(text[at:] if to < 0 else text[at:to]))
            if to < 0:
                return parts[0] if len(parts) == 1 else b"".join(parts)
            at = to

    def _words(self, text: str) -> bytes:
        """Slices after the first begin with a space, so that their first word is empty."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, encode = self.known, self.words.encode_ordinary
        words = text.split(" ")
        ids = list(map(known.get, words))
        ids[0] = array("I", encode(words[0])).tobytes()
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            word = words[at]
            ids[at] = known.get(word) or known.setdefault(word, array("I", encode(" " + word)).tobytes())
        return b"".join(ids)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end: int = 2) -> DataFrame:
    """(id, piece, start, length, ids): the pieces of each document; ids are little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids"]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        tokenizer = _tokenizer(str(path))

        def batch_of(rows: list[tuple], of: pa.RecordBatch) -> pa.RecordBatch:
            at, piece, start, size, ids = zip(*rows)
            return pa.RecordBatch.from_arrays([of.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], names)

        for batch in batches:
            rows, held = [], 0
            for at, text in enumerate(batch.column(1)):
                ids = tokenizer.encode(text.as_py()) + last
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)]
                rows += [(at, piece, i, j - i, ids[4 * i : 4 * j]) for piece, (i, j) in enumerate(zip(cuts, cuts[1:]))]
                held += len(ids)
                if held > 8 << 20:
                    yield batch_of(rows, batch)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, batch)
            del rows
        release()

    return map_texts(rows, run, f"id {kind}, piece int, start long, length long, ids binary")


class Packer:
    """Online sum-of-squares packing of item lengths into bins of a fixed capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 is not open
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fills: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        c = self.capacity
        gaps = self.open[size:]
        after = self.open[: c + 1 - size].copy()
        after[0] = 0
        # Change of the sum of squares: -2 n(g) + 1 for the gap that goes, 2 n(g - size) + 1 for the one that comes.
        change = 1 - 2 * gaps + 2 * after + 1
        change[0] -= 1
        change[gaps == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * int(self.open[c - size]) + 1 if size < c else 0
        if change[best] <= fresh:
            gap = best + size
            at = self.stacks[gap].pop()
            self.open[gap] -= 1
        else:
            gap, at = c, len(self.fills)
            self.fills.append(0)
        offset = self.fills[at]
        self.fills[at] += size
        if gap > size:
            self.open[gap - size] += 1
            self.stacks[gap - size].append(at)
        return at, offset


def pack_lengths(sizes: list[int], capacity: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, whether the bin is full) of each of ``sizes``, which fall.

    What lies in bins that are not full is taken out and packed anew, as long as that saves a bin.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.zeros(len(sizes), bool)
    left, first, opened = np.arange(len(sizes)), 0, None
    for _ in range(rounds):
        packer = Packer(capacity)
        placed = np.array([packer.place(sizes[i]) for i in left], np.int64).reshape(-1, 2)
        unfilled = np.array(packer.fills, np.int64) < capacity
        if opened is not None and len(packer.fills) >= opened:
            break
        bins[left], offsets[left], full[left] = placed[:, 0] + first, placed[:, 1], ~unfilled[placed[:, 0]]
        first, opened = first + len(packer.fills), int(unfilled.sum())
        left = left[unfilled[placed[:, 0]]]
        if not len(left):
            break
    return bins, offsets, full


def sequence_ids(bins: np.ndarray, task: int, level: int) -> np.ndarray:
    """Numbers from 0 that no other (bin, task, level) has."""
    if len(bins) and bins.max() >> BIN_BITS or task >> TASK_BITS or level >> (63 - BIN_BITS - TASK_BITS):
        raise ValueError("too many sequences in a task, tasks or rounds for 63 bits")
    return bins | (task << BIN_BITS) | (level << (BIN_BITS + TASK_BITS))


def _pack(items: DataFrame, parts: int, capacity: int, level: int) -> DataFrame:
    """``items`` (length, ...) and bin, at, full: dealt evenly into ``parts`` tasks that pack by falling length."""
    schema = items.schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            bins, at, full = pack_lengths(t["length"].to_pylist(), capacity)
            for name, x in (("bin", sequence_ids(bins, TaskContext.get().partitionId(), level)), ("at", at), ("full", full)):
                t = t.append_column(name, pa.array(x))
            yield from t.combine_chunks().to_batches(10_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return items.repartition(parts).sortWithinPartitions(F.col("length").desc(), *[c for c in names if c != "length"]).mapInArrow(run, f"{kinds}, bin long, at long, full boolean")


def assign_sequences(pieces: DataFrame, length: int = 1024, shard: int = 1 << 16, most_rounds: int = 16) -> DataFrame:
    """``pieces`` (a written table with id, piece, start, length, ...) and sequence_id, offset.

    Sequence ids are distinct numbers; offsets within a sequence are gapless from 0.
    """
    done = pieces.where(F.col("length") >= length).withColumn("bin", -1 - F.monotonically_increasing_id()).withColumn("at", F.lit(0).cast("long"))
    left, held, level = pieces.where(F.col("length") < length), None, 0
    while True:
        parts = parts_for(left.count(), shard)
        placed = materialize(_pack(left, parts, length, level), f"packed-{level}")
        # Each sequence has one piece at its start.
        counted = {r.full: r["count"] for r in placed.where("at = 0").groupBy("full").count().collect()}
        open_ = counted.get(False, 0)
        saved = None if held is None else held - open_ - counted.get(True, 0)
        held = open_
        if parts == 1 or level == most_rounds - 1 or (saved is not None and saved <= open_ / 1000):
            return done.unionByName(placed.drop("full")).withColumnRenamed("bin", "sequence_id").withColumnRenamed("at", "offset")
        done = done.unionByName(placed.where("full").drop("full"))
        left, level = placed.where("NOT full").drop("bin", "at", "full"), level + 1


def pack_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end: int = 2, shard: int = 1 << 16) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize_pieces(docs, vocabulary, id_col, text_col, length, end)
    narrow = materialize(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return assign_sequences(narrow, length, shard).select(F.col("id").alias(id_col), F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end: int = 2) -> DataFrame:
    """(sequence_id, ids array<long>, doc_ids): the packed sequences of ``pack_documents``, each of at most ``length`` tokens.

    Pieces meet their places by id, piece and checksum; rows that repeat an id must not differ.
    """
    pieces = tokenize_pieces(docs, vocabulary, id_col, text_col, length, end).withColumn("ids_crc32", F.crc32("ids"))
    pieces = pieces.dropDuplicates(["id", "piece", "ids_crc32"]).select(F.col("id").alias("_id"), F.col("piece").alias("_piece"), F.col("ids_crc32").alias("_crc"), "ids")
    rows = packed.join(pieces, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")) & (F.col("ids_crc32") == F.col("_crc")))
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id")))).alias("_parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), batch.column(2)], ["sequence_id", "ids", "doc_ids"])

    joined = grouped.select("sequence_id", F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "").alias("_hex"), F.transform("_parts", lambda p: p["id"]).alias("doc_ids"))
    kind = joined.schema["doc_ids"].dataType.simpleString()
    return joined.select("sequence_id", F.unhex("_hex").alias("ids"), "doc_ids").mapInArrow(decode, f"sequence_id long, ids array<long>, doc_ids {kind}")
