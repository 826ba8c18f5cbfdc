"""Helpers shared by the corpus operators: table access, shared storage, partial sums."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_path  # noqa: F401

#: The characters that count as white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def blank_slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Slices of about ``size`` bytes of a text, cut before a blank; none is cut off."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = BLANK.search(text, min(at + size, len(text)))
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def word_slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a list for each slice of about ``size`` bytes, so that long texts don't become one long list."""
    return map(bytes.split, blank_slices(text, size))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters (see ``SPACES``)."""
    marks = F.regexp_replace(F.rtrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", ".")
    return F.length(marks).cast("long")


def row_words(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns of a row, 128 bits in all."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    # A null leaves the hash as it is, so which columns are null is hashed too.
    cols += [F.col(f"`{c}`").isNull() for c in df.columns]
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *reversed(cols))


def learns(id_col: Column, folds: int, held_out: int) -> Column:
    """False for the held-out fold: rows whose crc32(id as text) mod ``folds`` is ``held_out``. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def tree_sum(vectors: DataFrame, width: int, dtype: str, fan_in: int = 32) -> np.ndarray:
    """Sum of the arrays in the one binary column of ``vectors`` (a few per task), each of ``width`` items of ``dtype``.

    ``fan_in`` tasks add them one after another, and the driver adds at most ``fan_in`` sums, whatever the number of
    tasks. An empty input gives zeros.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width, dtype), False
        for batch in batches:
            for x in batch.column(0):
                total, some = total + np.frombuffer(x.as_py(), dtype), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = np.zeros(width, dtype)
    for row in vectors.toDF("v").repartition(fan_in).mapInArrow(add, "v binary").collect():
        total = total + np.frombuffer(bytes(row[0]), dtype)
    return total


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, heavy: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key, a written table) on ``keys``, whatever the size of a group.

    Groups of more than total / heavy rows number fewer than ``heavy``: they are broadcast, and their rows don't
    shuffle. The rest are joined by key. ``keys`` are not null. ``how``: inner or left.
    """
    values = [c for c in groups.columns if c not in keys]
    large = groups.where(F.col(size_col) > total / heavy).withColumn("_large", F.lit(True))
    marked = rows.join(F.broadcast(large), keys, "left")
    hot = marked.where("_large").drop("_large")
    rest = marked.where("_large IS NULL").drop("_large", *values)
    return hot.unionByName(rest.join(groups, keys, how))


BITMAP = 1 << 15


def in_filter(rows: DataFrame, key: Column, known: DataFrame, bits_per_key: int = 16, most_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` and ``_maybe``: false only if ``key`` (long) is none of the values in the one column of ``known``.

    A Bloom filter in SQL functions only: bitmaps of 32,768 bits, two bits a key in one of them, all of at most
    ``most_bytes``, broadcast. Beyond that size the filter fills, and more rows are taken for known.
    """
    count = known.count()
    blocks = min(max(1, -(-count * bits_per_key // BITMAP)), most_bytes * 8 // BITMAP)

    def bits(k: Column) -> list[Column]:
        h = F.xxhash64(k, F.lit("bits"))
        return [h.bitwiseAND(BITMAP - 1), F.shiftrightunsigned(h, 15).bitwiseAND(BITMAP - 1)]

    block = lambda k: F.pmod(F.xxhash64(k, F.lit("block")), F.lit(blocks))
    marks = known.toDF("k").select(block(F.col("k")).alias("_block"), F.explode(F.array(*bits(F.col("k")))).alias("bit"))
    maps = marks.groupBy("_block").agg(F.bitmap_construct_agg("bit").alias("_map"))
    placed = rows.withColumn("_key", key).withColumn("_block", block(F.col("_key"))).join(F.broadcast(maps), "_block", "left")
    byte = lambda b: F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.lit(True)
    for b in bits(F.col("_key")):
        hit = hit & (F.pmod(F.floor(byte(b) / F.pow(F.lit(2), b.bitwiseAND(7))), F.lit(2)) == 1)
    return placed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_key", "_block", "_map")
