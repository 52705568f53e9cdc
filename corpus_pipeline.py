"""A corpus pipeline of five of the operators, as stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written and
read again before the next stage, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fareline.llm import exact_copies, near_copies, packing, personal_data, quality, tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws."""
    return quality.keep_good(docs, tables.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the largest id, of equal texts."""
    return exact_copies.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each class of similar texts."""
    return near_copies.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return personal_data.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into batches of a token budget."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("personal data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # no stage but the second can be said in SQL: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
