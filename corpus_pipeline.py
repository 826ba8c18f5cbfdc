"""The corpus pipeline: quality filter, exact and near deduplication, mixing, packing.

Every stage takes all rows its predecessor kept. All but the last return the columns of ``documents``; a document that
the mix takes twice is two rows. The last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import materialize, table
from tickloom.llm.exact_dedup import drop_exact_duplicates
from tickloom.llm.mixing import mix_documents
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality import keep_good
from tickloom.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs, stored=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Fingerprints three bits apart find few copies at a similarity of 0.8, so sets of five words are held against each other too.
    return drop_near_duplicates(docs, shingle=5, similarity=0.8, stored=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]
#: Classifiers, components and packings are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
