"""Dead letters: K4 record building, A11 depth, R7 retention, R8 replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave import constants as C

GIVE_UP = "GIVE_UP"
NOT_LISTED = "NOT_LISTED"
#: Fields of an ingest manifest row, kept whole as a dead letter's payload.
RECORD = ("status", "bucket", "source_key", "processed_key", "chunk_count", "pii_masked_flag",
          "pii_entity_counts", "reason", "error_type", "error_message")


def to_dead_letters(failed: DataFrame, stage: str, failed_at: Column | None = None,
                    payload_cols: list[str] | None = None, attempt: Column | None = None) -> DataFrame:
    """K4: whole failing record serialised as JSON with stage, error and time."""
    cols = payload_cols or failed.columns
    return failed.select(
        (failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"),
        F.lit(stage).alias("stage"),
        F.col("error_type").cast("string").alias("error_type"),
        F.col("error_message").cast("string").alias("error_message"),
        (attempt if attempt is not None else F.lit(1)).cast("int").alias("attempt"),
        F.to_json(F.struct(*cols)).alias("payload"))


def depth(dlq: DataFrame) -> DataFrame:
    """Dead-letter count per stage, error type and day (partial aggregation)."""
    return dlq.groupBy("stage", "error_type", F.to_date("failed_at").alias("day")) \
              .agg(F.count(F.lit(1)).cast("bigint").alias("depth"))


def retain(dlq: DataFrame, days: int = C.DLQ_RETENTION_DAYS) -> DataFrame:
    """Keep records newer than (latest failure - ``days``). The latest failure is a
    scalar subquery (one global max), not a driver round trip or a join."""
    latest = dlq.agg(F.max("failed_at")).scalar()
    return dlq.where(F.col("failed_at") > latest - F.expr(f"INTERVAL {int(days)} DAYS"))


def replay(dlq: DataFrame, max_attempts: int = C.MAX_ATTEMPTS) -> DataFrame:
    """Next attempt number and decision (RETRY until ``max_attempts``, then GIVE_UP)."""
    nxt = F.col("attempt") + 1
    return dlq.select("*", nxt.alias("next_attempt"),
                      F.when(nxt <= max_attempts, F.lit("RETRY")).otherwise(F.lit("GIVE_UP"))
                       .alias("replay_action"))


def replay_ingest(dlq: DataFrame, objects: DataFrame, process, max_attempts: int = C.MAX_ATTEMPTS):
    """R8 for ingestion: re-run failed objects through the same pipeline.

    ``dlq`` holds ingest dead letters (payload JSON with ``source_key``); ``objects`` is
    the current object listing (``source_key`` + object columns); ``process`` is the
    batch function (e.g. ``ingest.process_objects``). Returns ``(processed, dead)``: the
    processed rows of the retried objects and the new dead letters. Each (bucket, key) is
    replayed once, from its highest attempt: still failing objects return with ``attempt +
    1``, objects that are no longer listed as ``NOT_LISTED``, and ``GIVE_UP`` ends a history
    at ``max_attempts``; an object given up before is left alone. Equi-joins on the key.
    """
    from docweave.operators import routing
    key = ["bucket", "source_key"]
    todo = (dlq.where(F.col("stage") == "ingest").select(
        F.coalesce(F.get_json_object("payload", "$.bucket"), F.lit(C.DEFAULT_BUCKET)).alias("bucket"),
        F.get_json_object("payload", "$.source_key").alias("source_key"), "attempt",
        (F.col("error_type") == GIVE_UP).alias("over"))
        .groupBy(*key).agg(F.max("attempt").alias("attempt"), F.max("over").alias("over"))
        .where(~F.coalesce(F.col("over"), F.lit(False))))
    retry = todo.where(F.col("attempt") < max_attempts)
    gave_up = todo.where(F.col("attempt") >= max_attempts)
    listed = objects.join(retry, key, "left_semi")
    missing = retry.join(objects.select(*key), key, "left_anti")
    processed = process(listed)
    failed = processed.where(routing.route_of(F.col("status")) == "DLQ").join(retry, key)
    again = to_dead_letters(failed.select(*[c for c in failed.columns if c[0] != "_"]), "ingest",
                            payload_cols=[c for c in RECORD if c in failed.columns],
                            attempt=F.col("attempt") + 1)

    def outcome(rows: DataFrame, kind: str, message: str, attempt: Column) -> DataFrame:
        return rows.select(F.current_timestamp().alias("failed_at"), F.lit("ingest").alias("stage"),
                           F.lit(kind).alias("error_type"), F.lit(message).alias("error_message"),
                           attempt.cast("int").alias("attempt"),
                           F.to_json(F.struct(*key)).alias("payload"))

    return processed, (again.unionByName(outcome(
        gave_up, GIVE_UP, f"gave up after {max_attempts} attempts", F.col("attempt")))
        .unionByName(outcome(missing, NOT_LISTED, "object is not listed any more", F.col("attempt") + 1)))
