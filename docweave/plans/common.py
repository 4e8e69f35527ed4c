"""Shared plan fragments: the chunk index built from the supplied documents (Spark and
SQL forms) and the question set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T
from docweave.operators import chunking, embedding, redaction
from docweave.operators.ingest import chunk_key
from docweave.plans import sqltext as S
from docweave.sources.tables import read_table, source_documents

# Dimension used by the registered queries (the supplied `embeddings` table is 64-d;
# text vectors use the default hashing width).
TEXT_DIM = C.EMBED_DIMENSIONS


def chunk_rows(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """Redacted chunks of every document (optionally only those matching ``where``, a
    filter on document columns pushed into the scan) with index metadata, no vector."""
    red = redaction.redact_documents(source_documents(spark, sf_dir, where))
    ch = chunking.chunk_documents(red, "redacted_text",
                                  keep=["doc_id", "bucket", "source_key", "lang", "source",
                                        "pii_masked_flag"])
    return ch.select(
        chunk_key(F.col("bucket"), F.col("source_key"), F.col("chunk_id")).alias("chunk_key"),
        "doc_id", "lang", "source", F.col("source_key").alias("source_document"),
        "chunk_id", "token_count", "text_chunk", "pii_masked_flag",
        T.processed_key("source_key").alias("processed_key"))


def chunk_rows_checkpointed(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """:func:`chunk_rows` materialised once (reliable checkpoint in the shared checkpoint
    folder) for plans that read the chunks twice -- vectors for the search, text and
    metadata for the hits -- instead of redacting and cutting the corpus twice."""
    return chunk_rows(spark, sf_dir, where).checkpoint(eager=True)


def chunk_index(spark: SparkSession, sf_dir: str, dim: int = TEXT_DIM) -> DataFrame:
    """Chunk rows plus their hashing-embedder vector (ARRAY<DOUBLE>)."""
    return embedding.embed(chunk_rows(spark, sf_dir), "text_chunk", "vector", dim)


def questions(spark: SparkSession, sf_dir: str, dim: int = TEXT_DIM) -> DataFrame:
    """Every benchmark text is a question: ``query_id, question, query_vector``."""
    b = read_table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), T.strip("text").alias("question"))
    return embedding.embed(q, "question", "query_vector", dim)


# ------------------------------------------------------------------ SQL mirrors

def chunk_rows_sql() -> str:
    """CTE text ending in relation ``chunk_rows`` (same columns as :func:`chunk_rows`)."""
    return f"""{S.SRC_DOCS_CTE}, {S.redaction_ctes()},
{S.chunk_ctes('redacted', 'redacted_text', 'doc_id, bucket, source_key, lang, source, pii_masked_flag')},
chunk_rows AS (
  SELECT sha256(bucket || ':' || source_key || ':' || CAST(chunk_id AS VARCHAR)) AS chunk_key, doc_id, lang, source,
         source_key AS source_document, chunk_id, token_count, text_chunk, pii_masked_flag,
         'processed/' || regexp_replace(replace(source_key, '/', '_'), '(?i)\\.(pdf|txt)$', '') || '/chunks.json'
           AS processed_key
  FROM chunks)"""


def weights_sql(rel: str, id_col: str, text_col: str, out: str, dim: int = TEXT_DIM) -> str:
    """CTEs computing the hashing embedder in long form: ``out(id, bucket, weight)``
    with unrounded weights (zero weights dropped)."""
    return f"""{out}_tok AS (SELECT {id_col}, unnest(regexp_extract_all(lower({text_col}), {S.q(S.TOKEN_RE)})) AS _t FROM {rel}),
{out}_code AS (SELECT {id_col}, ('0x' || substr(md5(_t), 1, 8))::BIGINT % {dim} AS bucket,
   CASE WHEN ('0x' || substr(md5(_t), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM {out}_tok),
{out}_w0 AS (SELECT {id_col}, bucket, sum(sgn) AS w FROM {out}_code GROUP BY {id_col}, bucket),
{out}_nrm AS (SELECT {id_col}, sqrt(sum(w * w)) AS nrm FROM {out}_w0 GROUP BY {id_col}),
{out} AS (SELECT {id_col}, bucket, w / nrm AS weight FROM {out}_w0 JOIN {out}_nrm USING ({id_col})
          WHERE nrm > 0 AND w <> 0)"""


def questions_sql() -> str:
    return f"qtext AS (SELECT item_id AS query_id, {S.strip_sql('text')} AS question FROM benchmark)"


def text_scores_sql(k: int = C.TOP_K, index_rel: str = "chunk_rows") -> str:
    """CTEs: question weights, chunk weights, sparse dot products and top-k ``hits``."""
    return f"""{questions_sql()},
{weights_sql('qtext', 'query_id', 'question', 'qw')},
{weights_sql(index_rel, 'chunk_key', 'text_chunk', 'cw')},
qv AS (SELECT DISTINCT query_id FROM qw),
cv AS (SELECT DISTINCT chunk_key FROM cw),
sparse AS (SELECT qw.query_id, cw.chunk_key, sum(qw.weight * cw.weight) AS dot
           FROM qw JOIN cw USING (bucket) GROUP BY qw.query_id, cw.chunk_key),
scores AS (SELECT qv.query_id, cv.chunk_key, round(COALESCE(sparse.dot, 0), 6) AS score
           FROM qv CROSS JOIN cv LEFT JOIN sparse
             ON sparse.query_id = qv.query_id AND sparse.chunk_key = cv.chunk_key),
hits0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank
          FROM scores),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_key, score FROM hits0 WHERE rank <= {k})"""
