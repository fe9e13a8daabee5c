"""A training-data pipeline over `documents`: rejects low quality, removes repeated lines
and near duplicates, mixes sources to target weights and packs the result.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import linededup, mixing, neardup, packing, quality
from quire.llm.common import table, work_folder

#: SQL can't express the fitted classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, shrunk over their sites, is at least 0.5."""
    columns = docs.columns
    return quality.classify(docs, table(spark, sf_dir, "labels"), prefix="__q_").where("__q_keep").select(*[F.col(f"`{c}`") for c in columns])


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier line by their words; n_chars follows the text.

    A document all of whose lines were seen before, and that had text, is gone with them.
    """
    columns = docs.columns
    cleaned = linededup.dedup_lines(docs, prefix="__q_").where("NOT (__q_removed > 0 AND trim(text) = '')")
    return _counted(cleaned).select(*[F.col(f"`{c}`") for c in columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates."""
    return neardup.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
