"""Line deduplication by overlapping three-line windows, in DataFrame expressions only.

A document's lines that are not blank form windows of ``window`` lines, one starting at each line. Windows are hashed
to 128 bits, repeated hashes are found over the whole corpus, and every occurrence but the first (smallest id, then
smallest position) marks the lines it covers; the marked positions of a document are merged and deleted.

Counting and the first occurrence are aggregated before the shuffle, so that a line found in a third of all documents
sends one row per task. Occurrences meet the repeated hashes in a join by hash, those of very common windows in a broadcast.
Of the texts only those that may have lines to remove shuffle, to meet their positions; a broadcast Bloom filter of bounded
size lets the others pass where they lie.

Defined results: a null text is empty and has no lines; documents of fewer lines than a window keep all; blank lines
are never counted or removed; documents with a null id keep all their lines and mark none of others; rows that
repeat an id with the same text are one document and don't repeat each other, those with another text are documents of their
own, in the order of a hash of their texts; an empty table gives an empty result; extra columns are ignored. Lines are
compared after white space at their ends is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, in_filter, join_groups, materialize, text_of


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _numbered(lines: Column) -> Column:
    """The lines that are not blank, in order: struct<at: place among all lines, line: trimmed>."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(SPACES)).alias("line"))), lambda x: x["line"] != "")


def _document(id_col: str, text_col: str) -> Column:
    """What makes rows one document: the id and the text, by its hash."""
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("text"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(doc struct<id, text: hash>, positions): for each document with lines to remove, their positions among its non-blank lines, from 0."""
    lines = docs.where(F.col(f"`{id_col}`").isNotNull()).select(_document(id_col, text_col).alias("_doc"), F.transform(_numbered(_lines(text_of(text_col))), lambda x: x["line"]).alias("_lines"))
    starts = F.when(F.size("_lines") >= window, F.sequence(F.lit(0), F.size("_lines") - window)).otherwise(F.array().cast("array<int>"))
    key = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("_lines", i + 1, window)).alias("h1"), F.xxhash64(F.lit(window), F.reverse(F.slice("_lines", i + 1, window))).alias("h2")))
    windows = materialize(lines.select("_doc", F.explode(key).alias("_w")).select("_doc", "_w.*"), "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "pos")).alias("_first")).where("_n > 1")
    first = materialize(first, "repeated-windows")
    later = join_groups(windows, first, ["h1", "h2"], "_n", windows.count()).where((F.col("_doc") != F.col("_first._doc")) | (F.col("pos") != F.col("_first.pos")))
    covered = later.groupBy("_doc").agg(F.collect_set("pos").alias("_starts"))
    spread = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + (window - 1)))))
    return covered.select(F.col("_doc").alias("doc"), spread.alias("positions"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row per document: ``id_col``, n_lines (not blank), removed_lines, clean_text."""
    marks = materialize(repeated_lines(docs, id_col, text_col, window).select("doc", F.xxhash64("doc").alias("_key"), "positions"), "repeated-lines")
    rows = docs.select(_document(id_col, text_col).alias("_doc"), text_of(text_col).alias("_text"))
    rows = in_filter(rows, F.xxhash64("_doc"), marks.select("_key"))
    alone = rows.where("NOT _maybe").select("_doc", "_text", F.lit(None).cast("array<int>").alias("positions"))
    marked = rows.where("_maybe").join(marks.select("doc", "positions"), F.col("_doc") == F.col("doc"), "left").select("_doc", "_text", "positions")

    def cleaned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_all", _lines(F.col("_text"))).withColumn("_lines", _numbered(F.col("_all")))
        dead = F.transform("positions", lambda p: F.get(F.col("_lines"), p)["at"])
        alive = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), dead)
        clean = F.when(F.col("positions").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(alive, lambda i: F.get(F.col("_all"), i)), "\n"))
        return rows.select(F.col("_doc.id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("removed_lines"), clean.alias("clean_text"))

    return cleaned(marked).unionByName(cleaned(alone))
