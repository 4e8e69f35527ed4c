"""Declared schemas of every record docweave reads or writes (Spark DDL strings)."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("text_chunk", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("start_token", T.IntegerType()),
    T.StructField("end_token", T.IntegerType()),
])

PROCESSED_DOCUMENT = T.StructType([
    T.StructField("source_document", T.StringType()),
    T.StructField("source_bucket", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("pii_masked_flag", T.BooleanType()),
    T.StructField("pii_entity_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("chunk_size_tokens", T.IntegerType()),
    T.StructField("chunk_overlap_tokens", T.IntegerType()),
    T.StructField("chunks", T.ArrayType(CHUNK)),
])

INDEX_ROW = T.StructType([
    T.StructField("chunk_key", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("text_chunk", T.StringType()),
    T.StructField("source_bucket", T.StringType()),
    T.StructField("source_document", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("pii_masked_flag", T.BooleanType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("processed_key", T.StringType()),
])

DEAD_LETTER = T.StructType([
    T.StructField("failed_at", T.TimestampType()),
    T.StructField("stage", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

ACCESS_LOG = T.StructType([T.StructField(n, T.StringType()) for n in (
    "requestId", "ip", "caller", "user", "requestTime", "httpMethod", "resourcePath", "status",
    "protocol", "responseLength", "apiKeyId")])
