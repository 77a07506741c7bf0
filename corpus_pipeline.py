"""Cleaning of a document corpus in stages, each written as Parquet and read by the next.

Quality classifier, near-duplicates, personal data, mixing, byte-level BPE. Every stage works
on all that its predecessor kept; all but the last return the columns of ``documents``.
Stage files go to a new folder under the session's ``spark.checkpoint.dir`` and stay there for
whoever wants to look at a stage; delete the folder when the result has been used.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import bpe, mixing, neardup, pii, quality
from sigweave.llm.common import settle, table
from sigweave.operators.common import checkpoint_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject (score >= 0.3)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("predicted") == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group that shares 80 % of its five-word shingles.

    Rows that repeat an id are one document: one of them stays. Documents without words belong
    to no group and stay. Rows without an id belong to no group either; of those with the same text one stays.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = settle(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"))
    if again.isEmpty():  # every row has an id of its own: texts are read once
        return kept
    known = kept.filter(F.col("doc_id").isNotNull())
    once = known.join(again, "doc_id", "left_anti").select(*docs.columns)
    repeated = known.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    unnamed = kept.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return once.unionByName(repeated).unionByName(unnamed)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document of the mix."""
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage),
    ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can express neither the trees nor the token merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
