"""From raw documents to packed sequences: each stage is one operator, its result written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capframe.llm import decontaminate, packing, pii, quality, simhash
from capframe.llm.common import materialize, read, ship_package, small_batches


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from ``labels``."""
    small_batches(spark)
    labels = read(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.fit(quality.document_stats(docs), labels))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    small_batches(spark)
    return simhash.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts."""
    ship_package(spark)
    small_batches(spark)
    return pii.mask(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in the packed sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("simhash", first_copies),
    ("decontamination", clean_of_benchmark),
    ("pii", without_personal_data),
    ("packing", sequences),
]

#: The learned stages have no SQL; the rows are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
