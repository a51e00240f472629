"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

quality classifier -> line dedup -> SimHash near-dedup -> benchmark
decontamination -> byte-level BPE. All but the last return the columns of
documents; the last returns one row of counts and digests for each document
that is left.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import bpe, decontaminate, lines, quality, simhash, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all but the first document that has them; every document stays."""
    found = lines.drop_recurring(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id."""
    return simhash.dedup_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.round_trip(docs, *bpe.public_ranks(), ["doc_id", "lang", "source"])


def bounded(stage):
    """The stage in a session with small batches, as its executors also hold what the stages before have left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", bounded(keep_good)),
    ("line dedup", bounded(drop_lines)),
    ("simhash near-dedup", bounded(near_dedup)),
    ("benchmark decontamination", bounded(decontaminated)),
    ("byte-level bpe", bounded(encode)),
]

#: SQL has no XXH64 and cannot express the classifier or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            store.drop(before)
        before = docs
    return docs
