"""A training-data pipeline over ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; each result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, line_dedup, packing, quality_knn, shingle_join
from runlens.llm.common import among, settle, table
from runlens.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of copies alone stays with an empty text."""
    kept = line_dedup.dedup_lines(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id stays; null ids come last."""
    rows = settle(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    return among(rows, shingle_join.representatives(rows)).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontaminate", benchmark), ("packing", pack)]
#: Neither neighbour votes nor a genetic algorithm can be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
