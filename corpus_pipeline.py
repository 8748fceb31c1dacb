"""The corpus pipeline: each stage reads what its predecessor wrote and returns a DataFrame.

All stages but the last return the columns of ``documents``; the last returns the packed sequences' pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, exact_dedup, packing, quality_gam, simhash
from quillon.llm.catalogue import WORD_BPE, table
from quillon.llm.common import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest id stays."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its bin, place and bin length."""
    return packing.packed_documents(docs, WORD_BPE)


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_once), ("simhash near-dedup", near_once), ("benchmark decontamination", uncontaminated), ("best-fit packing", packed)]

#: Trained scores, fingerprints and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
