"""A corpus from raw documents to packed token sequences.

Quality rules, line dedup, SimHash near-dedup, mixing to target weights, packing: each stage works
on all that its predecessor kept. All but the last return the columns of the documents, whatever
else these have and however named. A table without rows gives none at any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm import line_dedup, mixing, packing, quality_rules, simhash
from lumenvec.llm.common import remove, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts do not. Rows are judged alone, so repeats stay, as do null ids and sources.
    """
    return quality_rules.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; those left without a word go.

    Rows without id lose no line and count for none. Rows that repeat an id are one document: its
    lines recur only if another id has them. Null texts stay null, and stay.
    """
    return line_dedup.filter_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Null and empty texts are equal to each other. Rows without id stay; rows that repeat the id of the
    one that stays do too.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice, in the schedule's order.

    Null sources are one source; texts without a word are not taken; repeated rows are told apart.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences, with their ids.

    Each row gets its own pieces, whatever its id; a null text has the end token alone.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, templates and tokenisation have no SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again.

    Results that have been read are deleted; that of the last stage is what is returned.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
