"""Corpus pipeline: documents through language ID, exact dedup, SimHash near-dedup, mixing
to target weights and byte-level BPE. Each stage is written as Parquet and read again as the
next one's documents.

Defined results: a null or empty text, or one without a letter, goes in the first stage, so later
stages see texts only. Ids may be null or repeat: stages tell rows by id and text, and rows
equal in both count as one document from exact dedup on. Of equal texts the row of the largest
id stays (a null id only if all are null), of near ones that of the smallest, then of the
smallest text digest. Languages tied in score go to the first in the alphabet. An empty table gives
no rows at every stage. All stages but the last keep the documents' columns, whatever further
ones there are and however they are named. A text must fit into a row; very long ones are
read whole."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm import byte_bpe, exact_dedup, lang_id, mixing, simhash
from docweave.llm.common import prepare
from docweave.session import scratch_path

BPE_FILE = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    return lang_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest id."""
    prepare(spark)
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints, the one of the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of domains keeps."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return mixing.mixed(docs, labels)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    prepare(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near),
          ("mixing", mix), ("byte_bpe", encode)]

#: Classifiers, the star contraction and BPE are beyond SQL; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
