"""Row routing: F1-F7 filters and the status router, as per-row columns (no shuffle).

Every input row yields exactly one status row -- SUCCESS, SKIPPED or FAILED with an
error type and message -- so a bad object never fails the job (defect X9 of the
per-object handler is avoided by construction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T

SUCCESS, SKIPPED, FAILED = "SUCCESS", "SKIPPED", "FAILED"


def route_objects(df: DataFrame, key_col: str = "source_key", text_col: str = "text",
                  extract_error_col: str | None = "extract_error") -> DataFrame:
    """F2 -> F1 -> extraction -> F3: add ``status, reason, error_type, error_message``.

    The recursion guard runs before the extension check, so anything under
    ``processed/`` is SKIPPED (not FAILED) whatever its suffix.
    """
    key = F.col(key_col)
    ext_err = F.col(extract_error_col) if extract_error_col and extract_error_col in df.columns \
        else F.lit(None).cast("string")
    skipped = T.is_processed_key(key)
    bad_ext = ~T.has_allowed_extension(key)
    blank = T.is_blank(F.col(text_col))
    status = (F.when(skipped, F.lit(SKIPPED)).when(bad_ext, F.lit(FAILED))
              .when(ext_err.isNotNull(), F.lit(FAILED)).when(blank, F.lit(FAILED))
              .otherwise(F.lit(SUCCESS)))
    reason = F.when(skipped, F.lit("object_under_processed_prefix"))
    etype = (F.when(skipped, F.lit(None)).when(bad_ext, F.lit("ValueError"))
             .when(ext_err.isNotNull(), F.lit("RuntimeError")).when(blank, F.lit("ValueError")))
    emsg = (F.when(skipped, F.lit(None))
            .when(bad_ext, F.concat(F.lit("Unsupported object key extension: "), key))
            .when(ext_err.isNotNull(), ext_err)
            .when(blank, F.lit("Extracted text is empty")))
    return df.select("*", status.alias("status"), reason.alias("reason"),
                     etype.cast("string").alias("error_type"), emsg.cast("string").alias("error_message"))


def route_of(status: Column) -> Column:
    """SUCCESS -> next stage, SKIPPED -> end, anything else (incl. NULL) -> DLQ."""
    return (F.when(status == SUCCESS, F.lit("NEXT")).when(status == SKIPPED, F.lit("END"))
            .otherwise(F.lit("DLQ")))


def vectorize_gate(manifest: DataFrame) -> DataFrame:
    """only SUCCESS rows with at least one chunk go to the embedder; the rest get the
    error the vectorizer would raise."""
    is_success = F.coalesce(F.col("status") == SUCCESS, F.lit(False))   # NULL status is not
    ok = is_success & (F.coalesce(F.col("chunk_count"), F.lit(0)) > 0)
    err = (F.when(~is_success,
                  F.concat(F.lit("Expected SUCCESS payload, got status="),
                           F.coalesce(F.col("status"), F.lit("None"))))
           .when(~ok, F.lit("No chunks found in processed payload")))
    return manifest.select("*", F.when(ok, F.lit("VECTORIZE")).otherwise(F.lit("DLQ")).alias("gate"),
                           err.alias("gate_error"))


def pii_type_filter(spans: DataFrame, type_col: str = "type") -> DataFrame:
    """keep detector entities of the five accepted types and map each to its label
    (CREDIT_DEBIT_NUMBER -> CREDIT_CARD). A literal map lookup: no join, no shuffle."""
    m = F.create_map(*[x for k, v in C.PII_TYPE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return spans.withColumn("label", m[F.col(type_col)]).where(F.col("label").isNotNull())
