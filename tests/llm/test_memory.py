"""How much of a table a Python worker gets at once."""

import re

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.common import materialize
from tickloom.llm.in_place import file_label, select_rows
from tickloom.llm.memory import BATCH, BATCH_BYTES
from tickloom.llm.quality import keep_good


def test_batches_are_bounded_by_bytes(spark):
    rows, size = 4000, 10_000
    docs = materialize(spark.range(rows).coalesce(1).select("id", F.repeat(F.lit("x"), size).alias("text")), "t")

    def decide():
        return lambda label, a, b: np.full(len(a), len(a) * size <= 1.1 * BATCH)

    spark.conf.unset(BATCH_BYTES)
    assert select_rows(docs, file_label(), F.col("id"), F.col("id"), decide).count() == rows
    # A bound that is set already stays.
    spark.conf.set(BATCH_BYTES, str(BATCH // 8))
    select_rows(docs, file_label(), F.col("id"), F.col("id"), decide)
    assert spark.conf.get(BATCH_BYTES) == str(BATCH // 8)
    spark.conf.unset(BATCH_BYTES)


def test_quality_sends_a_text_once(spark):
    rows = [(k, None if k == 7 else ("good words " * (k % 9 + 1) if k % 2 else f"|{k}|" * (k % 5 + 1))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # The id and the text, which come back too: no second copy of the text under a name of its own.
    sent = re.search(r"MapInArrow good\(([^)]*)\)", plan)[1].split(",")
    assert len(sent) == 2
    # A text that must be cast first gives the same rows.
    cast = keep_good(docs.withColumn("text", F.col("text").cast("binary")), labels)
    assert sorted(r.doc_id for r in cast.collect()) == sorted(r.doc_id for r in kept.collect()) != []
