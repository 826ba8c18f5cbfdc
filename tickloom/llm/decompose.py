"""Packing without padding: documents are cut into pieces of power-of-two lengths, and pieces of equal length share a bucket.

A document of n tokens gives n // ``length`` pieces of full length and one for each set bit of the rest, from the largest
down. Every piece is a sequence of its own, as long as its bucket says: no sequence crosses documents, no token is
padding, and batches of a fixed number of tokens are drawn from one bucket (2**k sequences of length ``length`` / 2**k).

Documents are tokenized and cut where they lie, in one pass: nothing shuffles, and a task holds the ids of one text at a
time (4 bytes each). A document gives at most n / length + log2(length) pieces. Sequence numbers are those of the rows of a
task after those of the tasks before, so a task that runs again gives the same numbers.

``write_buckets`` writes the token ids themselves, one folder per length.

Defined results: a null text is empty and gives one piece, the end token; rows that repeat an id are cut each for itself;
a null id is kept as it is; an empty table gives an empty result; extra columns are ignored. ``length`` is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .memory import release
from .packing import _tokenizer


def binary_cuts(tokens: int, length: int) -> list[int]:
    """Where the pieces of ``tokens`` tokens begin, and ``tokens`` itself."""
    cuts = list(range(0, tokens - tokens % length + 1, length))
    while cuts[-1] < tokens:
        cuts.append(cuts[-1] + (1 << ((tokens - cuts[-1]).bit_length() - 1)))
    return cuts


def decompose_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, bucket (the exponent of the length), sequence_id,
    offset; ``with_ids`` adds ids, little-endian unsigned 32-bit integers."""
    if length < 1 or length & (length - 1):
        raise ValueError(f"{length} is not a power of two")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    last = np.array([end], "<u4").tobytes()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        tokenizer = _tokenizer(str(path))

        def batch_of(pieces: list[tuple], of: pa.RecordBatch) -> pa.RecordBatch:
            at, *cols = zip(*pieces)
            return pa.RecordBatch.from_arrays([of.column(0).take(pa.array(at)), *[pa.array(c, kind) for c, (_, kind) in zip(cols, fields)]], ["id", *[name for name, _ in fields]])

        for batch in batches:
            pieces, held = [], 0
            for at, text in enumerate(batch.column(1)):
                ids = tokenizer.encode(text.as_py()) + last
                n = len(ids) // 4
                cuts = binary_cuts(n, length)
                for i, j in zip(cuts, cuts[1:]):
                    own = ids[4 * i : 4 * j]
                    pieces.append((at, i, j - i, zlib.crc32(own), n, *([own] if with_ids else [])))
                held += len(ids) if with_ids else 40 * len(cuts)
                if held > 8 << 20:
                    yield batch_of(pieces, batch)
                    pieces, held = [], 0
            if pieces:
                yield batch_of(pieces, batch)
            del pieces
        release()

    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long{', ids binary' if with_ids else ''}")
    return cut.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.log2(F.col("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def write_buckets(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end: int = 1, most_rows: int = 1 << 18) -> None:
    """Token sequences with their ids under ``path``/bucket=k, files of at most ``most_rows`` sequences; a rerun replaces them."""
    decompose_documents(docs, vocabulary, id_col, text_col, length, end, with_ids=True).write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy("bucket").parquet(path)


def bucket_report(pieces: DataFrame) -> DataFrame:
    """(bucket, length, sequences, tokens): what each bucket holds, for the mix of lengths in training."""
    return pieces.groupBy("bucket").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))
