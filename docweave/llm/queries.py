"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import (byte_bpe, conversation_repair, exact_dedup, filter_audit, lang_id,
                          license_scan, line_dedup, mixing, quality_rules, simhash,
                          substring_dedup, token_counts, token_order)
from docweave.llm.common import documents, prepare

BPE_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
SPAN_WORDS = 25         # of a repeated span: half of the 50 words from which a passage counts


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_order.training_order(documents(spark, sf_dir, "doc_id", "text"),
                                       public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return found.select("slot", "shard", "doc_id", "seq_no", "n_tokens",
                        F.sha2("ids", 256).alias("ids_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"),
                                     public_tokenizers.path(PIECE_FILE))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir, "doc_id", "text"),
                                     license_scan.default_templates(spark))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir, "doc_id", "text"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text"), labels)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir, "doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removed_spans(documents(spark, sf_dir, "doc_id", "text"), min_words=SPAN_WORDS)
    return found.select("doc_id", "n_removed", "removed")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"),
                               public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return filter_audit.filter_audit(documents(spark, sf_dir, "doc_id", "text", "source"), labels)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    talks = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return conversation_repair.audit(conversation_repair.damage(talks), talks)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_training_order, op2_token_counts, op3_exact_dedup, op4_license_scan, op5_simhash,
    op6_lang_id, op7_mixing, op8_quality_rules, op9_substring_dedup, op10_byte_bpe,
    op11_filter_audit, op12_conversation_repair, op13_line_dedup)}
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE_SQL,
           "op8_quality_rules": quality_rules.ORACLE_SQL,
           "op11_filter_audit": filter_audit.ORACLE_SQL,
           "op12_conversation_repair": conversation_repair.ORACLE_SQL,
           "op13_line_dedup": line_dedup.ORACLE_SQL}
