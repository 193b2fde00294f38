"""The corpus pipeline: five operators in a row, each over all that the one before kept.

Null and empty texts, and texts without a letter, go with the first stage. Of repeated rows one stays, whatever their doc_ids;
rows of one or of no doc_id are told apart by their place, never joined by it. Of equal texts the least doc_id stays (null last),
of near copies the least doc_id of their group (null last). All columns of documents pass through every stage but the last, whatever their names;
texts of any length are read whole. No documents give no pieces; a benchmark without items drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dnslens.llm import decontaminate, exact_dedup, language_id, near_copies, packing
from dnslens.llm.common import new_folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, fitted on these documents' own labels; rejected documents go."""
    return language_id.keep_known(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word shingle similarity of 0.8 or more one stays."""
    return near_copies.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs).drop("key")


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: A trained model and a tokenizer take part: SQL can't express the pipeline. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
