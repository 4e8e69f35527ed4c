"""Sinks: K1 processed documents, K2/K3 vector index (appended, merged on read),
K4 dead letters, K5 benchmark report, K6 answer records. Plain Parquet and JSON folders."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from docweave import constants as C
from docweave import schemas
from docweave.operators.retrieval import split_by_width


# ------------------------------------------------------------------ K1

def write_processed_documents(docs: DataFrame, path: str, fmt: str = "json",
                              mode: str = "append") -> None:
    """K1: one nested record per source document, chunks in ``chunk_id`` order,
    partitioned by bucket. Appends: a reprocessed source gets a newer record and readers
    keep the latest per source (:func:`read_processed_documents`), so one run never
    replaces other sources' records (no whole-partition overwrite)."""
    out = docs.withColumn("chunks", F.array_sort("chunks"))
    out.write.mode(mode).partitionBy("source_bucket").format(fmt).save(path)


def read_processed_documents(spark: SparkSession, path: str, fmt: str = "json",
                             latest: bool = True) -> DataFrame:
    """S3: read processed documents back with the declared schema (no inference); with
    ``latest`` only the newest record per source document (by ``processed_at``, then chunk
    count and a digest of the chunks). Older records are found from narrow columns and taken
    out by an anti-join, so the nested chunks are neither sorted nor, while the list of older
    records is small, shuffled. Only records stored twice alike are grouped, to keep one."""
    schema = TY.StructType([f for f in schemas.PROCESSED_DOCUMENT.fields if f.name != "source_bucket"]
                           + [TY.StructField("processed_key", TY.StringType()),
                              TY.StructField("source_bucket", TY.StringType())])
    r = spark.read.schema(schema)
    df = r.format(fmt).load(path) if fmt != "json" else r.json(path)
    if not latest:
        return df
    source = ["source_bucket", "source_document"]
    made = F.struct("processed_at", "chunk_count", F.xxhash64("chunks").alias("digest"))
    rows = df.withColumn("made", made)
    narrow = rows.select(*source, "made")
    newest = narrow.groupBy(*source).agg(F.max("made").alias("newest"))
    old = _matched(narrow, newest, source, "inner").where("made < newest").select(*source, "made").distinct()
    rows = _matched(rows, old, [*source, "made"], "left_anti")
    twice = narrow.groupBy(*source, "made").count().where("count > 1").select(*source).distinct()
    once = _matched(rows, twice, source, "left_semi").dropDuplicates(source)
    return _matched(rows, twice, source, "left_anti").unionByName(once).drop("made")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys in which nulls are equal; keys of ``right`` are not returned."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys))
    return left.join(named, same, how).drop(*[f"_r_{c}" for c in keys])


# ------------------------------------------------------------------ K2 / K3

def ensure_index(spark: SparkSession, base: str) -> None:
    """K3: an empty index at ``base`` unless there is one."""
    empty = spark.createDataFrame([], schemas.INDEX_ROW).withColumn("write_id", F.lit(""))
    empty.write.mode("ignore").partitionBy("write_id").parquet(base)


def write_index(rows: DataFrame, base: str, dim: int = C.EMBED_DIMENSIONS,
                batch_id: int | None = None, stream_id: str | None = None) -> DataFrame:
    """K2: append index rows; the cost is that of the rows, never of the index.

    Rows without a vector of ``dim`` elements are not stored: they are returned with
    ``error_type`` and ``error_message`` for the dead letters. A micro-batch passes its
    ``batch_id`` and its stream's lasting ``stream_id``, so that a replay replaces its own rows
    and never those of another stream. Write ids rise with the batch, or with time."""
    if (batch_id is None) != (stream_id is None):
        raise ValueError("a micro-batch is named by its number and its stream")
    good, bad = split_by_width(rows, dim)
    good = good.select(*[F.col(f.name).cast(f.dataType) for f in schemas.INDEX_ROW.fields])
    write_id = (f"w{time.time_ns():020d}-{uuid.uuid4().hex}" if batch_id is None
                else f"b{int(batch_id):015d}-{stream_id}")
    good.write.mode("overwrite").parquet(f"{base.rstrip('/')}/write_id={write_id}")
    return bad


def read_index(spark: SparkSession, base: str, latest: bool = True) -> DataFrame:
    """Index rows; with ``latest`` only those of each document's newest generation.

    A generation is what one write stored for one (bucket, document), so chunks that a
    shorter or newly redacted version no longer has are gone. Superseded generations are
    found from three narrow columns and taken out by an anti-join; vectors are not shuffled
    while that list is small enough to broadcast, which the planner decides by its size."""
    ensure_index(spark, base)
    fields = [*schemas.INDEX_ROW.fields, TY.StructField("write_id", TY.StringType())]
    df = spark.read.schema(TY.StructType(fields)).parquet(base)
    if not latest:
        return df.drop("write_id")
    doc, made = ["source_bucket", "source_document"], F.struct("timestamp", "write_id")
    made_by = df.select(*doc, "timestamp", "write_id").distinct()
    newest = made_by.groupBy(*doc).agg(F.max(made).alias("newest"))
    old = made_by.join(newest, doc).where(made < F.col("newest")).select(*doc, "timestamp", "write_id")
    return df.join(old, [*doc, "timestamp", "write_id"], "left_anti").drop("write_id")


def compact_index(spark: SparkSession, base: str, out: str) -> None:
    """Write the newest generations of the index at ``base`` as a new index at ``out``."""
    rows = read_index(spark, base)
    rows.write.mode("errorifexists").parquet(f"{out.rstrip('/')}/write_id=w{time.time_ns():020d}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ K4 / K5 / K6

def append_dead_letters(dlq: DataFrame, path: str) -> None:
    """K4: append dead letters (declared schema) partitioned by failure date."""
    rows = dlq.select(*[F.col(f.name).cast(f.dataType) for f in schemas.DEAD_LETTER.fields])
    rows.withColumn("failed_date", F.to_date("failed_at")).write.mode("append") \
        .partitionBy("failed_date").parquet(path)


def answer_json(records: DataFrame) -> DataFrame:
    """K6: ``status_code`` and the JSON body per answer record. A 400 says what the request
    lacks; a 500 names the error's type and message."""
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in records.columns else default

    failed = F.struct(F.lit(C.QUERY_FAILED).alias("error"),
                      given("error_type", F.lit("Exception")).alias("error_type"),
                      given("error_message", F.lit("")).alias("error_message"))
    body = (F.when(F.col("status_code") == 200,
                   F.to_json(F.struct("answer", "sources", "retrieved_count", "model_id",
                                      "embed_model_id", "usage", "latency_ms")))
            .when(F.col("status_code") == 400,
                  F.to_json(F.struct(given("error_message", F.lit(C.MISSING_QUESTION)).alias("error"))))
            .otherwise(F.to_json(failed)))
    return records.select("query_id", "status_code", body.alias("body"))


def write_report(report: DataFrame, path: str) -> None:
    """K5: the one-row benchmark report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)
