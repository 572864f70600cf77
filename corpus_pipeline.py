"""A training-text pipeline: quality rules, line dedup, near-dedup, private data, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Cases: null and empty texts are rejected by the quality rules. A document whose lines all repeat
earlier ones goes with them. Rows with null or repeated ids are documents of their own. An empty table gives an empty result at each stage. Further columns are kept until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.llm import linededup, neardup, packing, pii, quality
from lindero.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones, exactly or but for one edit."""
    return _counted(linededup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return neardup.dedup(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.mask(docs, pii.trained(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("lines", line_dedup),
    ("near", near_dedup),
    ("private", private_data),
    ("packing", best_fit_packing),
]

#: SQL cannot express the near-duplicate, private-data and packing stages; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
