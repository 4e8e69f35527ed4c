"""Ingestion queries: tokenize, redact, chunk, compose."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import pii as P
from docweave.functions import text as T
from docweave.operators import chunking, redaction
from docweave.plans import sqltext as S
from docweave.plans.catalog import query
from docweave.sources.tables import read_documents, source_documents

q = S.q


@query("chunk_documents", oracle=f"""
WITH {S.chunk_ctes('documents', 'text', 'doc_id')}
SELECT doc_id, chunk_id, token_count, start_token, end_token, text_chunk FROM chunks""")
def chunk_documents(spark, sf_dir):
    """T2 (flagship): every document cut into 500-token chunks with 50-token overlap."""
    docs = read_documents(spark, sf_dir, ["doc_id", "text"])
    return chunking.chunk_documents(docs, "text", keep=["doc_id"])


@query("tokenize_documents", oracle=f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {q(S.TOKEN_RE)})) AS BIGINT) AS n_tokens,
       md5(array_to_string(regexp_extract_all(text, {q(S.TOKEN_RE)}), ' ')) AS tokens_md5
FROM documents""")
def tokenize_documents(spark, sf_dir):
    """Token count and a digest of the token sequence per document."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"]).select("doc_id", T.tokens("text").alias("tok"))
    return d.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tok", " ")).alias("tokens_md5"))


@query("pii_redact", oracle=f"""
WITH {S.SRC_DOCS_CTE}, {S.redaction_ctes()}
SELECT doc_id, n_credit_card, n_ssn, n_phone, n_email, pii_masked_flag, redacted_text FROM redacted""")
def pii_redact(spark, sf_dir):
    """P8 + A1 + A2: pattern redaction of every document with per-label counts."""
    red = redaction.redact_documents(source_documents(spark, sf_dir))
    return red.select("doc_id", "n_credit_card", "n_ssn", "n_phone", "n_email",
                      "pii_masked_flag", "redacted_text")


@query("pii_counts", oracle=f"""
WITH {S.SRC_DOCS_CTE}, {S.redaction_ctes()},
long AS (
  SELECT doc_id, 'CREDIT_CARD' AS label, n_credit_card AS n FROM redacted UNION ALL
  SELECT doc_id, 'SSN', n_ssn FROM redacted UNION ALL
  SELECT doc_id, 'PHONE', n_phone FROM redacted UNION ALL
  SELECT doc_id, 'EMAIL', n_email FROM redacted)
SELECT doc_id, label, CAST(n AS BIGINT) AS n FROM long WHERE n > 0""")
def pii_counts(spark, sf_dir):
    """A1: entity count per document and label (the map, exploded; labels with 0 absent)."""
    red = redaction.redact_documents(source_documents(spark, sf_dir))
    return red.select("doc_id", F.explode("pii_entity_counts").alias("label", "n")) \
              .select("doc_id", "label", F.col("n").cast("bigint").alias("n"))


@query("pii_flags", oracle=f"""
WITH {S.SRC_DOCS_CTE}, {S.redaction_ctes()},
{S.chunk_ctes('redacted', 'redacted_text', 'doc_id, pii_masked_flag')}
SELECT doc_id, chunk_id, pii_masked_flag,
       contains(text_chunk, '[REDACTED_') AS chunk_has_marker FROM chunks""")
def pii_flags(spark, sf_dir):
    """A2: document flag (copied to each chunk) and the true per-chunk marker flag."""
    red = redaction.redact_documents(source_documents(spark, sf_dir))
    ch = chunking.chunk_documents(red, "redacted_text", keep=["doc_id", "pii_masked_flag"])
    return ch.select("doc_id", "chunk_id", "pii_masked_flag",
                     F.col("text_chunk").contains("[REDACTED_").alias("chunk_has_marker"))


@query("pii_rollup", oracle=f"""
WITH {S.SRC_DOCS_CTE}, {S.redaction_ctes()}
SELECT source, lang, CAST(sum(n_credit_card) AS BIGINT) AS sum_credit_card,
       CAST(sum(n_ssn) AS BIGINT) AS sum_ssn, CAST(sum(n_phone) AS BIGINT) AS sum_phone,
       CAST(sum(n_email) AS BIGINT) AS sum_email,
       CAST(count(*) FILTER (WHERE pii_masked_flag) AS BIGINT) AS masked_docs,
       CAST(count(*) AS BIGINT) AS docs
FROM redacted GROUP BY ROLLUP (source, lang)""")
def pii_rollup(spark, sf_dir):
    """A3: corpus PII totals by source and language with subtotals (rollup)."""
    red = redaction.redact_documents(source_documents(spark, sf_dir))
    return redaction.pii_rollup(red, ["source", "lang"])


@query("residual_pii_audit", oracle=f"""
WITH {S.SRC_DOCS_CTE}, {S.redaction_ctes()},
{S.chunk_ctes('redacted', 'redacted_text', 'doc_id')}
SELECT CAST(count(*) AS BIGINT) AS chunks,
{", ".join(f"CAST(COALESCE(sum(len(regexp_extract_all(text_chunk, {q(p)}))), 0) AS BIGINT) AS residual_{l.lower()}" for l, p in P.PII_PATTERNS)}
FROM chunks""")
def residual_pii_audit(spark, sf_dir):
    """Pattern matches left in indexed chunk text after redaction (expected 0)."""
    red = redaction.redact_documents(source_documents(spark, sf_dir))
    ch = chunking.chunk_documents(red, "redacted_text", keep=["doc_id"])
    audited = redaction.residual_pii(ch, "text_chunk")
    res = [c for c in audited.columns if c.startswith("residual_")]
    return audited.agg(F.count(F.lit(1)).cast("bigint").alias("chunks"),
                       *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in res])
