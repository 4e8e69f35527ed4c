"""Ingestion operations queries: routing, manifests, keys, sources, sinks, dead letters.

The object listing stands for a bucket: every document as ``uploads/<source>/<id>.txt``,
every web page as ``crawl/<host><path>`` (no .pdf/.txt suffix -> rejected), and the
processed output object of every document (under ``processed/`` -> skipped).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import pii as P
from docweave.functions import text as T
from docweave.operators import (deadletters, ingest, redaction, routing, segmentation)
from docweave.operators import names as name_lists
from docweave.plans import common
from docweave.plans import sqltext as S
from docweave.plans.catalog import query
from docweave.session import scratch_path
from docweave.sinks import tables as sinks
from docweave.sources import events as ev
from docweave.sources import objects as obj
from docweave.sources.tables import read_documents, read_table, source_documents

q = S.q
RUN_TS = "2024-02-01 00:00:00"
PAGE_KEY_RE = r"^https?://|[?#].*$"
EXT_RE = r"\.(pdf|txt)$"


def listing(spark, sf_dir):
    docs = source_documents(spark, sf_dir).select("bucket", "source_key", "text")
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit(C.DEFAULT_BUCKET).alias("bucket"),
        F.concat(F.lit("crawl/"), F.regexp_replace("url", PAGE_KEY_RE, "")).alias("source_key"),
        F.col("html").alias("text"))
    processed = docs.select("bucket", T.processed_key("source_key").alias("source_key"),
                            F.lit("{}").alias("text"))
    return docs.unionByName(pages).unionByName(processed)


def processed(spark, sf_dir):
    return ingest.process_objects(listing(spark, sf_dir), processed_at=RUN_TS)


def _pkey_sql(col: str) -> str:
    return (f"'processed/' || regexp_replace(replace({col}, '/', '_'), '(?i)\\.(pdf|txt)$', '') "
            f"|| '/chunks.json'")


LISTING_SQL = f"""{S.SRC_DOCS_CTE},
listing AS (
  SELECT bucket, source_key, text FROM src_docs
  UNION ALL SELECT '{C.DEFAULT_BUCKET}', 'crawl/' || regexp_replace(url, {q(PAGE_KEY_RE)}, '', 'g'), html FROM pages
  UNION ALL SELECT bucket, {_pkey_sql('source_key')}, '{{}}' FROM src_docs),
routed AS (
  SELECT bucket, source_key,
    CASE WHEN starts_with(source_key, 'processed/') THEN 'SKIPPED'
         WHEN NOT regexp_matches(lower(source_key), {q(EXT_RE)}) THEN 'FAILED'
         WHEN text IS NULL OR NOT regexp_matches(text, {q(T.RE2_NON_BLANK_PATTERN)}) THEN 'FAILED'
         ELSE 'SUCCESS' END AS status,
    CASE WHEN starts_with(source_key, 'processed/') THEN 'object_under_processed_prefix' END AS reason,
    CASE WHEN starts_with(source_key, 'processed/') THEN NULL
         WHEN NOT regexp_matches(lower(source_key), {q(EXT_RE)}) THEN 'ValueError'
         WHEN text IS NULL OR NOT regexp_matches(text, {q(T.RE2_NON_BLANK_PATTERN)}) THEN 'ValueError' END AS error_type,
    CASE WHEN starts_with(source_key, 'processed/') THEN NULL
         WHEN NOT regexp_matches(lower(source_key), {q(EXT_RE)}) THEN 'Unsupported object key extension: ' || source_key
         WHEN text IS NULL OR NOT regexp_matches(text, {q(T.RE2_NON_BLANK_PATTERN)}) THEN 'Extracted text is empty' END AS error_message,
    text
  FROM listing),
ok_docs AS (SELECT * FROM routed WHERE status = 'SUCCESS'),
{S.redaction_ctes('ok_docs', 'text')},
counted AS (SELECT *, len({S.tokens_sql('redacted_text')}) AS _ntok FROM redacted),
ok_man AS (SELECT source_key, CAST(CASE WHEN _ntok = 0 THEN 0 WHEN _ntok <= {S.SIZE} THEN 1
              ELSE 1 + CAST(ceil((_ntok - {S.SIZE}) / {S.STEP}.0) AS BIGINT) END AS INTEGER) AS chunk_count,
              pii_masked_flag,
              NULLIF(concat_ws(',', CASE WHEN n_credit_card > 0 THEN 'CREDIT_CARD' END,
                               CASE WHEN n_email > 0 THEN 'EMAIL' END,
                               CASE WHEN n_phone > 0 THEN 'PHONE' END,
                               CASE WHEN n_ssn > 0 THEN 'SSN' END), '') AS pii_labels
           FROM counted),
manifest AS (
  SELECT r.status, r.bucket, r.source_key,
         CASE WHEN r.status = 'SUCCESS' THEN {_pkey_sql('r.source_key')} END AS processed_key,
         m.chunk_count, m.pii_masked_flag,
         CASE WHEN r.status = 'SUCCESS' THEN COALESCE(m.pii_labels, '') END AS pii_labels,
         r.reason, r.error_type, r.error_message
  FROM routed r LEFT JOIN ok_man m ON r.status = 'SUCCESS' AND m.source_key = r.source_key)"""


def _manifest_flat(spark, sf_dir):
    man = ingest.ingest_manifest(processed(spark, sf_dir))
    labels = F.array_join(F.array_sort(F.map_keys("pii_entity_counts")), ",")
    return man.select("status", "bucket", "source_key", "processed_key", "chunk_count",
                      "pii_masked_flag", labels.alias("pii_labels"), "reason", "error_type",
                      "error_message")


@query("ingest_manifest", oracle=f"WITH {LISTING_SQL} SELECT * FROM manifest")
def ingest_manifest(spark, sf_dir):
    """A4 + F1/F2/F3: one status row per listed object."""
    return _manifest_flat(spark, sf_dir)


@query("status_router", oracle=f"""WITH {LISTING_SQL}
SELECT CASE WHEN status = 'SUCCESS' THEN 'NEXT' WHEN status = 'SKIPPED' THEN 'END' ELSE 'DLQ' END AS route,
       status, CAST(count(*) AS BIGINT) AS objects
FROM manifest GROUP BY ALL""")
def status_router(spark, sf_dir):
    """objects per route (next stage / end / dead letters)."""
    man = _manifest_flat(spark, sf_dir)
    return man.groupBy(routing.route_of(F.col("status")).alias("route"), "status") \
              .agg(F.count(F.lit(1)).cast("bigint").alias("objects"))


@query("vectorize_gate", oracle=f"""WITH {LISTING_SQL}
SELECT source_key, CASE WHEN status = 'SUCCESS' AND COALESCE(chunk_count, 0) > 0 THEN 'VECTORIZE'
                        ELSE 'DLQ' END AS gate FROM manifest""")
def vectorize_gate(spark, sf_dir):
    """which manifest rows go on to the embedder."""
    return routing.vectorize_gate(_manifest_flat(spark, sf_dir)).select("source_key", "gate")


@query("filter_extension", oracle=f"""WITH {LISTING_SQL}
SELECT source_key, regexp_matches(lower(source_key), {q(EXT_RE)}) AS allowed FROM listing""")
def filter_extension(spark, sf_dir):
    """case-insensitive .pdf/.txt allowlist over the listing."""
    return listing(spark, sf_dir).select("source_key", T.has_allowed_extension("source_key").alias("allowed"))


@query("filter_recursion_guard", oracle=f"""WITH {LISTING_SQL}
SELECT source_key, starts_with(source_key, 'processed/') AS skipped FROM listing""")
def filter_recursion_guard(spark, sf_dir):
    """objects under processed/ are skipped."""
    return listing(spark, sf_dir).select("source_key", T.is_processed_key("source_key").alias("skipped"))


@query("filter_empty_text", oracle=f"""
SELECT doc_id, (doc_id % 5 < 2 OR text IS NULL OR NOT regexp_matches(text, {q(T.RE2_NON_BLANK_PATTERN)})) AS blank
FROM documents""")
def filter_empty_text(spark, sf_dir):
    """documents whose text has no non-whitespace character; every fifth extraction gave
    nothing and another fifth only white space."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"])
    d = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "").when(
        F.col("doc_id") % 5 == 1, " \u2003\n\x1c").otherwise(F.col("text")))
    return d.select("doc_id", T.is_blank("text").alias("blank"))


@query("processed_key", oracle=f"""WITH {S.SRC_DOCS_CTE}
SELECT source_key, {_pkey_sql('source_key')} AS processed_key FROM src_docs""")
def processed_key(spark, sf_dir):
    """Output key derived from each document's source key."""
    d = source_documents(spark, sf_dir)
    return d.select("source_key", T.processed_key("source_key").alias("processed_key"))


def _sanitize_sql(col: str) -> str:
    base = f"regexp_extract({col}, '[^/\\\\]*$')"
    ext = f"regexp_extract({base}, '(\\.[A-Za-z0-9]+)$', 1)"
    stem = f"left({base}, length({base}) - length({ext}))"
    stem = f"regexp_replace(regexp_replace({stem}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"
    stem = f"left(CASE WHEN {stem} = '' THEN 'document' ELSE {stem} END, {C.FILENAME_STEM_MAX})"
    return f"{stem} || lower({ext})", f"lower({ext})"


_SAN, _EXT = _sanitize_sql("url")


@query("sanitize_filename", oracle=f"""
SELECT page_id, {_SAN} AS safe_name, {_EXT} AS extension,
       {_EXT} IN ('.pdf', '.txt') AS accepted FROM pages""")
def sanitize_filename(spark, sf_dir):
    """P5: safe upload name and extension of every page URL taken as a file name."""
    p = read_table(spark, sf_dir, "pages")
    ext = T.filename_extension("url")
    return p.select("page_id", T.sanitize_filename("url").alias("safe_name"), ext.alias("extension"),
                    ext.isin(".pdf", ".txt").alias("accepted"))


@query("object_key", oracle=f"""
SELECT page_id, 'uploads/20240201T000000Z-' || left(sha256(CAST(page_id AS VARCHAR)), 8) || '-' || {_SAN} AS object_key,
       CASE WHEN page_id % 3 = 0 THEN 'text/html' WHEN {_EXT} = '.pdf' THEN 'application/pdf'
            ELSE 'text/plain' END AS content_type
FROM pages""")
def object_key(spark, sf_dir):
    """P6 + P7: upload key (stamp, 8 hex from the row id, safe name) and the content type, given
    for every third page, blank for another and absent for the rest."""
    p = read_table(spark, sf_dir, "pages")
    safe = T.sanitize_filename("url")
    given = F.when(F.col("page_id") % 3 == 0, " text/html ").when(F.col("page_id") % 3 == 1, "  ")
    return p.select("page_id",
                    T.object_key(safe, F.to_timestamp(F.lit(RUN_TS)), F.col("page_id")).alias("object_key"),
                    T.default_content_type(given, T.filename_extension("url")).alias("content_type"))


@query("processed_documents", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT source_document, CAST(count(*) AS INTEGER) AS chunk_count, bool_or(pii_masked_flag) AS pii_masked_flag,
       md5(string_agg(text_chunk, chr(1) ORDER BY chunk_id)) AS chunks_md5
FROM chunk_rows GROUP BY source_document""")
def processed_documents(spark, sf_dir):
    """K1: nested processed record per source (chunks built in-row, no grouping)."""
    docs = ingest.processed_documents(processed(spark, sf_dir))
    return docs.select("source_document", "chunk_count", "pii_masked_flag",
                       F.md5(F.array_join(F.transform("chunks", lambda c: c["text_chunk"]), "\u0001"))
                        .alias("chunks_md5"))


@query("ingest_end_to_end", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT chunk_key, source_document, chunk_id, token_count, pii_masked_flag, processed_key, text_chunk
FROM chunk_rows""")
def ingest_end_to_end(spark, sf_dir):
    """Listing -> route -> redact -> chunk -> keyed chunk rows ready to embed."""
    rows = ingest.chunk_rows(processed(spark, sf_dir))
    return rows.select("chunk_key", "source_document", "chunk_id", "token_count",
                       "pii_masked_flag", "processed_key", "text_chunk")


@query("chunks_explode_roundtrip", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT source_document, chunk_id, token_count, text_chunk FROM chunk_rows""")
def chunks_explode_roundtrip(spark, sf_dir):
    """K1 write + S3 read: processed JSON written, read back with the declared schema and
    exploded to one row per chunk."""
    path = scratch_path(spark, f"processed-{uuid.uuid4().hex}")
    sinks.write_processed_documents(ingest.processed_documents(processed(spark, sf_dir)), path)
    rows = ingest.explode_processed(sinks.read_processed_documents(spark, path))
    return rows.select("source_document", "chunk_id", "token_count", "text_chunk")


def _doc_id():
    return F.regexp_extract("source_document", r"/(\d+)\.txt$", 1).cast("bigint")


def _embedded(spark, sf_dir, status_only: bool = False):
    rows = ingest.chunk_rows(processed(spark, sf_dir))
    return ingest.embed_chunks(rows, common.TEXT_DIM, status_only=status_only)


@query("index_manifest", oracle=f"""WITH {common.chunk_rows_sql()},
{common.weights_sql('chunk_rows', 'chunk_key', 'text_chunk', 'cw')},
j AS (SELECT c.source_document, c.processed_key, c.pii_masked_flag,
             c.chunk_key IN (SELECT chunk_key FROM cw) AND NOT (doc_id % 6 = 0 AND chunk_id = 0) AS ok FROM chunk_rows c)
SELECT CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'FAILED'
            WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
       source_document, processed_key,
       CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS indexed_count,
       CAST(count(*) FILTER (WHERE NOT ok) AS INTEGER) AS failed_count,
       {common.TEXT_DIM} AS embed_dimensions
FROM j GROUP BY source_document, processed_key""")
def index_manifest(spark, sf_dir):
    """A5 (+PARTIAL): indexed / failed chunk counts per processed document; the embedder gave
    no usable vector for the first chunk of every sixth document."""
    e = _embedded(spark, sf_dir, status_only=True)
    e = e.withColumn("embed_status", F.when((_doc_id() % 6 == 0) & (F.col("chunk_id") == 0), "BAD_DIM")
                     .otherwise(F.col("embed_status")))
    m = ingest.index_manifest(e, common.TEXT_DIM)
    return m.select("status", "source_document", "processed_key", "indexed_count", "failed_count",
                    "embed_dimensions")


@query("index_reconcile", oracle=f"""WITH {common.chunk_rows_sql()}
, g AS (SELECT source_document, CAST(count(*) AS INTEGER) AS chunks_written,
  CAST(count(*) FILTER (NOT (doc_id % 5 = 0 AND chunk_id % 3 = 0)) AS INTEGER) AS chunks_indexed
  FROM chunk_rows GROUP BY source_document)
SELECT *, chunks_written - chunks_indexed AS missing,
       CASE WHEN chunks_indexed < chunks_written THEN 'MISSING' ELSE 'OK' END AS reconcile_status FROM g""")
def index_reconcile(spark, sf_dir):
    """Chunks written by ingestion vs chunks indexed, per source document; some chunks
    never reached the embedder."""
    p = processed(spark, sf_dir)
    man = ingest.ingest_manifest(p)
    sent = ingest.chunk_rows(p).where(~((_doc_id() % 5 == 0) & (F.col("chunk_id") % 3 == 0)))
    idx = ingest.index_manifest(ingest.embed_chunks(sent, common.TEXT_DIM, status_only=True), common.TEXT_DIM)
    return ingest.reconcile(man, idx)


@query("index_reconcile_chunks", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT source_document, chunk_id, 'MISSING' AS difference FROM chunk_rows WHERE doc_id % 5 = 0 AND chunk_id % 3 = 0
UNION ALL SELECT source_document, 990 + doc_id % 7, 'EXTRA' FROM chunk_rows WHERE doc_id % 4 = 1 AND chunk_id = 0
UNION ALL SELECT source_document, chunk_id, 'REPEATED' FROM chunk_rows WHERE doc_id % 9 = 2 AND doc_id % 5 <> 0 AND chunk_id = 0""")
def index_reconcile_chunks(spark, sf_dir):
    """Chunks of the stored processed documents against the stored index, from which some
    were left out, to which others were added, and in which some stand twice: all are named."""
    base = scratch_path(spark, f"reconcile-{uuid.uuid4().hex}")
    p = processed(spark, sf_dir)
    sinks.write_processed_documents(ingest.processed_documents(p), f"{base}/processed")
    doc_id = F.regexp_extract("source_document", r"/(\d+)\.txt$", 1).cast("bigint")
    rows = ingest.chunk_rows(p).select("*", F.lit(0.5).alias("x")).withColumn("vector", F.array("x")) \
        .withColumn("embed_status", F.lit("OK"))
    rows = ingest.index_rows(rows, RUN_TS).withColumn("d", doc_id)
    first = F.col("chunk_id") == 0
    # a chunk's rows in the index, none to three, come out of one pass over the documents
    forms = F.filter(F.array(
        F.when(~((F.col("d") % 5 == 0) & (F.col("chunk_id") % 3 == 0)), "kept"),
        F.when(first & (F.col("d") % 4 == 1), "old"),
        F.when(first & (F.col("d") % 9 == 2) & (F.col("d") % 5 != 0), "again")), lambda x: x.isNotNull())
    old = F.col("form") == "old"
    stored = rows.withColumn("form", F.explode(forms)).withColumn(
        "chunk_id", F.when(old, (990 + F.col("d") % 7).cast("int")).otherwise(F.col("chunk_id"))).withColumn(
        "chunk_key", F.when(old, F.sha2(F.concat("chunk_key", F.lit("-old")), 256)).otherwise(F.col("chunk_key")))
    sinks.write_index(stored.drop("d", "form"), f"{base}/index", 1)
    written = ingest.explode_processed(sinks.read_processed_documents(spark, f"{base}/processed"))
    return ingest.reconcile_chunks(written, sinks.read_index(spark, f"{base}/index")).select(
        "source_document", "chunk_id", "difference")


@query("incremental_new_objects", oracle=f"""WITH {LISTING_SQL}
SELECT source_key FROM listing
WHERE source_key NOT IN (SELECT source_key FROM src_docs)""")
def incremental_new_objects(spark, sf_dir):
    """Listed objects absent from the previous manifest (the documents already ingested)."""
    prev = ingest.ingest_manifest(ingest.process_objects(
        source_documents(spark, sf_dir).select("bucket", "source_key", "text"), processed_at=RUN_TS))
    return ingest.new_objects(listing(spark, sf_dir), prev).select("source_key")


def _index_two_runs(spark, sf_dir, second=None, latest=True):
    """Every document indexed, then (what ``second`` keeps of) it again a day later."""
    base = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    rows = ingest.index_rows(_embedded(spark, sf_dir), "2024-02-01 00:00:00")
    sinks.write_index(rows, base, common.TEXT_DIM)
    # the second run embeds nothing anew: it stores what the first one did at another time
    again = sinks.read_index(spark, base).withColumn("timestamp", F.to_timestamp(F.lit("2024-02-02 00:00:00")))
    sinks.write_index(again if second is None else again.where(second), base, common.TEXT_DIM)
    return sinks.read_index(spark, base, latest)


@query("index_upsert", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT chunk_key, source_document, chunk_id, '2024-02-02 00:00:00' AS ts FROM chunk_rows""")
def index_upsert(spark, sf_dir):
    """K2 upsert: documents indexed twice keep their newest generation."""
    idx = _index_two_runs(spark, sf_dir)
    return idx.select("chunk_key", "source_document", "chunk_id",
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("index_append", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT chunk_key, source_document, chunk_id, '2024-02-01 00:00:00' AS ts FROM chunk_rows
UNION ALL SELECT chunk_key, source_document, chunk_id, '2024-02-02 00:00:00' FROM chunk_rows""")
def index_append(spark, sf_dir):
    """K2 append (reference behaviour): all generations of a document."""
    idx = _index_two_runs(spark, sf_dir, latest=False)
    return idx.select("chunk_key", "source_document", "chunk_id",
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("index_shrink", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT chunk_key, source_document, chunk_id,
       CASE WHEN doc_id % 2 = 0 THEN '2024-02-02 00:00:00' ELSE '2024-02-01 00:00:00' END AS ts
FROM chunk_rows WHERE doc_id % 2 = 1 OR chunk_id = 0""")
def index_shrink(spark, sf_dir):
    """K2: documents of even id come back with their first chunk only; their other chunks
    are no longer in the index."""
    doc_id = F.regexp_extract("source_document", r"/(\d+)\.txt$", 1).cast("bigint")
    idx = _index_two_runs(spark, sf_dir, (doc_id % 2 == 0) & (F.col("chunk_id") == 0))
    return idx.select("chunk_key", "source_document", "chunk_id",
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("index_rejects", oracle="""
SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'missing vector'
                    WHEN vec_id % 7 = 0 THEN 'unexpected vector width ' || CAST(len(embedding) - 1 AS VARCHAR)
                    ELSE 'stored' END AS outcome FROM embeddings""")
def index_rejects(spark, sf_dir):
    """Vectors cut short (every 7th) or absent (every 11th) are not stored and come
    back as dead letters; what is stored is read from the written index."""
    e = read_table(spark, sf_dir, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    vector = (F.when(F.col("vec_id") % 11 == 0, F.lit(None))
              .when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, dim - 1)).otherwise(F.col("embedding")))
    key = F.col("vec_id").cast("string")
    rows = e.select(key.alias("chunk_key"), vector.cast("array<float>").alias("vector"), F.lit("").alias("text_chunk"),
                    F.lit(C.DEFAULT_BUCKET).alias("source_bucket"), key.alias("source_document"),
                    F.to_timestamp(F.lit(RUN_TS)).alias("timestamp"), F.lit(False).alias("pii_masked_flag"),
                    F.lit(0).alias("chunk_id"), F.lit("").alias("processed_key"))
    base = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    dead = deadletters.to_dead_letters(sinks.write_index(rows, base, dim).drop("vector"), "index")
    stored = sinks.read_index(spark, base).select(F.col("chunk_key").cast("bigint").alias("vec_id"),
                                                  F.lit("stored").alias("outcome"))
    return stored.unionByName(dead.select(
        F.get_json_object("payload", "$.chunk_key").cast("bigint").alias("vec_id"),
        F.col("error_message").alias("outcome")))


def _stored(spark, letters):
    """Dead letters written through the sink and read back, as a replay finds them."""
    path = scratch_path(spark, f"dead-letters-{uuid.uuid4().hex}")
    sinks.append_dead_letters(letters, path)
    return spark.read.parquet(path)


@query("dead_letter_rows", oracle=f"""WITH {LISTING_SQL}
SELECT '{RUN_TS}' AS failed_at, 'ingest' AS stage, error_type, error_message, 1 AS attempt,
       source_key AS payload_key FROM manifest WHERE status NOT IN ('SUCCESS', 'SKIPPED')""")
def dead_letter_rows(spark, sf_dir):
    """K4: failed ingestion rows as dead letters (whole row as JSON payload)."""
    man = ingest.ingest_manifest(processed(spark, sf_dir)).where(
        routing.route_of(F.col("status")) == "DLQ")
    d = _stored(spark, deadletters.to_dead_letters(man, "ingest", F.to_timestamp(F.lit(RUN_TS))))
    return d.select(F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("failed_at"), "stage",
                    "error_type", "error_message", "attempt",
                    F.get_json_object("payload", "$.source_key").alias("payload_key"))


# ---------------------------------------------------------------- dead letters from the log

ERR_TYPE_SQL = ("CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 34 THEN 'ThrottlingException' "
                "WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 67 THEN 'ValidationException' "
                "ELSE 'ModelTimeoutException' END")
ATTEMPT_SQL = "CAST(1 + floor(CAST(json_extract(props, '$.k') AS INTEGER) / 34) AS INTEGER)"
DLQ_SQL = f"""dlq AS (SELECT ts AS failed_at, 'query' AS stage, {ERR_TYPE_SQL} AS error_type,
                      {ATTEMPT_SQL} AS attempt, event_id FROM events WHERE event_type = 'error')"""


def query_dead_letters(spark, sf_dir):
    """Dead letters of the question API: every 'error' request of the log."""
    e = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    etype = (F.when(k < 34, "ThrottlingException").when(k < 67, "ValidationException")
             .otherwise("ModelTimeoutException"))
    failed = e.select("event_id", "user_id", "value", "props", F.col("ts").cast("timestamp").alias("ts"),
                      etype.alias("error_type"), F.lit("RAG query failed").alias("error_message"),
                      (1 + F.floor(k / 34)).cast("int").alias("attempt"))
    return deadletters.to_dead_letters(failed, "query", F.col("ts"),
                                       ["event_id", "user_id", "value", "props"], F.col("attempt"))


@query("dlq_depth", oracle=f"""WITH {DLQ_SQL}
SELECT stage, error_type, CAST(failed_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS depth
FROM dlq GROUP BY ALL""")
def dlq_depth(spark, sf_dir):
    """Dead-letter depth per stage, error type and day."""
    return deadletters.depth(query_dead_letters(spark, sf_dir))


@query("dlq_retention", oracle=f"""WITH {DLQ_SQL}
SELECT event_id, strftime(failed_at, '%Y-%m-%d %H:%M:%S.%f') AS failed_at FROM dlq
WHERE failed_at > (SELECT max(failed_at) FROM dlq) - INTERVAL 14 DAY""")
def dlq_retention(spark, sf_dir):
    """Dead letters kept by the 14-day retention rule."""
    kept = deadletters.retain(query_dead_letters(spark, sf_dir))
    return kept.select(F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"),
                       F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("failed_at"))


@query("dlq_replay", oracle=f"""WITH {DLQ_SQL}
SELECT event_id, attempt + 1 AS next_attempt,
       CASE WHEN attempt + 1 <= {C.MAX_ATTEMPTS} THEN 'RETRY' ELSE 'GIVE_UP' END AS replay_action FROM dlq""")
def dlq_replay(spark, sf_dir):
    """Payload parsed back, attempt counted up, retry until the third attempt."""
    r = deadletters.replay(query_dead_letters(spark, sf_dir))
    payload = F.from_json("payload", "event_id bigint, user_id bigint, value double, props string")
    return r.select(payload["event_id"].alias("event_id"), "next_attempt", "replay_action")


# ---------------------------------------------------------------- event / request sources

EVENT_KEY_SQL = ("'uploads/u' || CAST(user_id AS VARCHAR) || '/' || event_type || '+report%20' || "
                 "CAST(event_id AS VARCHAR) || '.txt'")


def event_records(spark, sf_dir):
    """Object-created records in the three shapes, built from the request log; some name no
    object and some are no JSON."""
    e = read_table(spark, sf_dir, "events")
    key = F.concat(F.lit("uploads/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"),
                   F.lit("+report%20"), F.col("event_id").cast("string"), F.lit(".txt"))
    b = F.lit(C.DEFAULT_BUCKET)
    shape = F.pmod(F.col("event_id"), F.lit(3))
    flat = F.to_json(F.struct(b.alias("bucket"), key.alias("key")))
    detail = F.to_json(F.struct(F.struct(F.struct(b.alias("name")).alias("bucket"),
                                         F.struct(key.alias("key")).alias("object")).alias("detail")))
    records = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.struct(b.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object"))
        .alias("s3"))).alias("Records")))
    js = (F.when(F.col("event_id") % 17 == 3, '{"detail": {"bucket": {}}}')
          .when(F.col("event_id") % 23 == 5, "{not json").when(shape == 0, flat).when(shape == 1, detail)
          .otherwise(records))
    return e.select("event_id", js.alias("event_json"))


@query("resolve_event_location", oracle=f"""
WITH e AS (SELECT *, event_id % 17 <> 3 AND event_id % 23 <> 5 AS ok FROM events)
SELECT event_id, CASE WHEN ok THEN '{C.DEFAULT_BUCKET}' END AS bucket,
       CASE WHEN ok THEN url_decode(replace({EVENT_KEY_SQL}, '+', ' ')) END AS key,
       CASE WHEN ok THEN CASE event_id % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'detail' ELSE 'records' END END AS event_shape,
       CASE WHEN ok THEN 'RESOLVED' ELSE 'FAILED' END AS resolve_status,
       CASE WHEN event_id % 17 = 3 THEN 'Unable to resolve bucket/key from event'
            WHEN event_id % 23 = 5 THEN 'invalid JSON' END AS resolve_error FROM e""")
def resolve_event_location(spark, sf_dir):
    """S2 + P3: bucket and decoded key from flat, detail and Records event shapes."""
    r = ev.resolve_event_location(event_records(spark, sf_dir))
    return r.select("event_id", "bucket", "key", "event_shape", "resolve_status", "resolve_error")


@query("parse_question_requests", oracle=f"""
SELECT item_id AS request_id, NULLIF({S.strip_sql('text')}, '') AS question,
       CASE WHEN {S.strip_sql('text')} = '' THEN 400 ELSE 200 END AS status_code,
       '***' AS api_key_header, 'application/json' AS content_type_header
FROM benchmark""")
def parse_question_requests(spark, sf_dir):
    """S4 + F8 + P11: question requests (every third body base64-encoded) parsed, with
    credential headers masked."""
    b = read_table(spark, sf_dir, "benchmark")
    body = F.to_json(F.struct(F.col("text").alias("question")))
    enc = F.pmod(F.col("item_id"), F.lit(3)) == 0
    req = b.select(F.col("item_id").alias("request_id"),
                   F.when(enc, F.base64(F.encode(body, "UTF-8"))).otherwise(body).alias("body"),
                   enc.alias("is_base64"),
                   F.create_map(F.lit("X-Api-Key"), F.concat(F.lit("key-"), F.col("item_id").cast("string")),
                                F.lit("Content-Type"), F.lit("application/json")).alias("headers"))
    p = ev.parse_question_requests(req)
    return p.select("request_id", F.when(F.col("status_code") == 200, F.col("question")).alias("question"),
                    "status_code", F.col("headers_masked")["X-Api-Key"].alias("api_key_header"),
                    F.col("headers_masked")["Content-Type"].alias("content_type_header"))


@query("page_assembly", oracle=f"""
SELECT conv_id AS doc_id, string_agg(COALESCE(text, ''), chr(10) ORDER BY turn) AS text,
       CAST(count(*) AS INTEGER) AS page_count
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def page_assembly(spark, sf_dir):
    """Document text from its pages in order (conversation turns stand in for pages;
    system turns play the pages whose extraction failed and are left out)."""
    c = read_table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text",
                     (F.col("role") == "system").alias("failed"))
    return obj.assemble_pages(pages, failed_col="failed")


@query("byte_segments", oracle="""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, true AS within_limit
FROM documents""")
def byte_segments(spark, sf_dir):
    """P10: every document cut into <= 4 KB UTF-8 segments at code-point (preferably
    whitespace) boundaries; concatenation restores the text exactly."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"])
    limit = 4096
    s = d.select("doc_id", segmentation.byte_segments(F.col("text"), limit).alias("seg"))
    return s.select(
        "doc_id", F.aggregate("seg", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"),
        F.md5(F.array_join("seg", "")).alias("text_md5"),
        F.aggregate("seg", F.lit(True), lambda a, x: a & (F.octet_length(x) <= limit)).alias("within_limit"))


# Senders' words in e-mail addresses stand in for a list of names: they occur in running text
# and inside addresses, so that spans overlap.
SENDER = r"([a-z]+)[.][0-9]+@"
SENDER_ONCE = r"(?<![a-z])([a-z]++)[.][0-9]++@"     # the same matches; a word is tried at its start alone
SPANS_SQL = f"""
names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{SENDER}', 1)) AS name FROM documents),
found AS ({" UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, regexp_extract_all(text, '{pattern}') AS m, "
    f"string_split_regex(text, '{pattern}') AS s FROM documents" for label, pattern in P.PII_PATTERNS)}
  UNION ALL SELECT doc_id, 'NAME', regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'),
            string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') FROM documents),
each AS (SELECT doc_id, label, unnest(m) AS m, unnest(s[1:len(m)]) AS s, unnest(range(len(m))) AS i FROM found),
placed AS (SELECT doc_id, label, m, sum(length(s) + length(m)) OVER (PARTITION BY doc_id, label ORDER BY i) AS e FROM each),
spans AS (SELECT doc_id, list_sort(list({{'b': e - length(m), 'n': -e, 't': label}})) AS x FROM placed
  WHERE label <> 'NAME' OR m IN (SELECT name FROM names) GROUP BY doc_id),
spliced AS (SELECT doc_id, text, list_reduce(list_prepend({{'b': 0::HUGEINT, 'n': 0::HUGEINT, 't': '', 'k': 0::BIGINT}},
    list_transform(x, lambda y: {{'b': y.b, 'n': y.n, 't': y.t, 'k': 0::BIGINT}})),
    lambda a, y: CASE WHEN y.b >= -a.n THEN {{'b': y.b, 'n': y.n, 'k': a.k + 1,
      't': concat(a.t, substring(text, (-a.n)::BIGINT + 1, (y.b + a.n)::BIGINT), '[REDACTED_', y.t, ']')}} ELSE a END) AS r,
    len(x) AS n_spans FROM documents JOIN spans USING (doc_id))"""


def _all_spans(d):
    """Spans of the four patterns (windowed as for a size-limited detector) and of the names."""
    found = F.regexp_extract_all("text", F.lit(SENDER_ONCE), F.lit(1))
    names = d.where(F.instr("text", "@") > 0).select(F.explode(found).alias("name")).distinct()
    patterns = segmentation.detect_spans(F.col("text"), max_bytes=C.DETECTOR_MAX_BYTES)
    return F.concat(patterns, name_lists.name_spans(F.col("text"), names))


@query("pii_redact_spans", oracle=f"""WITH {SPANS_SQL}
SELECT doc_id, CASE WHEN r IS NULL THEN d.text
         ELSE concat(r.t, substring(d.text, (-r.n)::BIGINT + 1)) END AS redacted_text,
       coalesce(n_spans, 0)::INTEGER AS spans_found, coalesce(r.k, 0)::INTEGER AS spans_kept
FROM documents d LEFT JOIN spliced s USING (doc_id)""")
def pii_redact_spans(spark, sf_dir):
    """P9 + U1 + J6 + W3: spans of all four patterns and of a list of names, overlaps resolved
    (earliest, then longest), spliced by code-point offsets."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"])
    found = d.select("doc_id", "text", _all_spans(d).alias("spans"))
    kept = redaction.resolve_overlaps(F.col("spans"))
    return found.select("doc_id", redaction.splice_spans(F.col("text"), F.col("spans")).alias("redacted_text"),
                        F.size("spans").alias("spans_found"), F.size(kept).alias("spans_kept"))


@query("pii_type_filter", oracle="""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'EMAIL' WHEN 'view' THEN 'NAME'
             WHEN 'purchase' THEN 'CREDIT_DEBIT_NUMBER' WHEN 'signup' THEN 'ADDRESS' ELSE 'SSN' END AS type
           FROM events)
SELECT event_id, type, CASE type WHEN 'CREDIT_DEBIT_NUMBER' THEN 'CREDIT_CARD' ELSE type END AS label
FROM e WHERE type IN ('SSN', 'EMAIL', 'NAME', 'PHONE', 'CREDIT_DEBIT_NUMBER')""")
def pii_type_filter(spark, sf_dir):
    """detector entity types filtered to the accepted five and mapped to labels (event
    types of the log stand in for detector entity types)."""
    e = read_table(spark, sf_dir, "events")
    t = (F.when(F.col("event_type") == "click", "EMAIL").when(F.col("event_type") == "view", "NAME")
         .when(F.col("event_type") == "purchase", "CREDIT_DEBIT_NUMBER")
         .when(F.col("event_type") == "signup", "ADDRESS").otherwise("SSN"))
    return routing.pii_type_filter(e.select("event_id", t.alias("type")))


# FIXED VALUES: a small gazetteer for the NAME detector (one- and two-word names).
GAZETTEER = ["Alice", "Bob", "Maria", "Jean", "Hans", "Carlos", "John Smith", "Anna Müller",
             "Marie Curie", "José García", "Thnt", "Ertion", "Onthat"]


@query("pii_name_gazetteer", oracle=f"""
WITH tok AS (SELECT doc_id, {S.tokens_sql('text')} AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS w1, unnest(list_concat(t[2:], [NULL])) AS w2 FROM tok),
names(name) AS (VALUES {", ".join("(" + q(n) + ")" for n in GAZETTEER)}),
grams AS (SELECT doc_id, regexp_replace(w1, '[^\\p{{L}}\\p{{N}}]+$', '') AS ngram FROM g
          UNION ALL SELECT doc_id, w1 || ' ' || regexp_replace(w2, '[^\\p{{L}}\\p{{N}}]+$', '') FROM g WHERE w2 IS NOT NULL),
hits AS (SELECT doc_id, count(*) AS n FROM grams JOIN names ON grams.ngram = names.name GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(h.n, 0) AS BIGINT) AS name_hits FROM documents d LEFT JOIN hits h USING (doc_id)""")
def pii_name_gazetteer(spark, sf_dir):
    """NAME mentions found by joining token uni/bi-grams to a gazetteer (broadcast:
    the name list is a fixed, small dimension)."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"])
    names = spark.createDataFrame([(n,) for n in GAZETTEER], "name string")
    hits = redaction.gazetteer_spans(d, names, "text", "doc_id")
    per = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("name_hits"))


@query("decode_text", oracle="""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN concat(html, chr(65533), 'b') ELSE html END AS t FROM pages)
SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM p""")
def decode_text(spark, sf_dir):
    """Page bodies as stored bytes (UTF-8) decoded leniently back to text: valid
    UTF-8 round-trips exactly, the invalid byte that every fourth page has becomes U+FFFD."""
    p = read_table(spark, sf_dir, "pages")
    whole = F.encode("html", "UTF-8")
    raw = p.select("page_id", F.when(F.col("page_id") % 4 == 1, F.concat(whole, F.unhex(F.lit("FF62"))))
                   .otherwise(whole).alias("content"))
    txt = raw.select("page_id", T.decode_utf8("content").alias("text"))
    return txt.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("dlq_replay_ingest", oracle=f"""WITH {LISTING_SQL}
SELECT source_key, error_type, 2 AS attempt FROM manifest WHERE status = 'FAILED'""")
def dlq_replay_ingest(spark, sf_dir):
    """R8 (ingestion): this run's ingest dead letters replayed through the same pipeline
    against the listing; objects failing again return with attempt 2."""
    man = ingest.ingest_manifest(processed(spark, sf_dir)).where(
        routing.route_of(F.col("status")) == "DLQ")
    dlq = _stored(spark, deadletters.to_dead_letters(man, "ingest", F.to_timestamp(F.lit(RUN_TS))))
    _, dead = deadletters.replay_ingest(
        dlq, listing(spark, sf_dir), lambda o: ingest.process_objects(o, processed_at=RUN_TS))
    return _stored(spark, dead).select(F.get_json_object("payload", "$.source_key").alias("source_key"),
                       "error_type", "attempt")


@query("dlq_replay_history", oracle=f"""WITH {LISTING_SQL},
failed AS (SELECT source_key, length(source_key) % 4 AS k FROM manifest WHERE status = 'FAILED')
SELECT source_key, CASE k WHEN 2 THEN 'GIVE_UP' WHEN 3 THEN 'NOT_LISTED' ELSE 'ValueError' END AS error_type,
       CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 2 END AS INTEGER) AS attempt
FROM failed""")
def dlq_replay_history(spark, sf_dir):
    """R8 over an append-only queue: objects with one, two and three attempts on record and
    objects no longer listed; one outcome each, from the highest attempt."""
    man = ingest.ingest_manifest(processed(spark, sf_dir)).where(F.col("status") == "FAILED")
    man = man.withColumn("k", F.length("source_key") % 4)
    history = man.withColumn("attempt", F.explode(F.when(F.col("k") == 1, F.array(F.lit(1), F.lit(2)))
                             .when(F.col("k") == 2, F.array(F.lit(1), F.lit(2), F.lit(3)))
                             .otherwise(F.array(F.lit(1)))))
    dlq = _stored(spark, deadletters.to_dead_letters(history, "ingest", F.to_timestamp(F.lit(RUN_TS)),
                                                     attempt=F.col("attempt")))
    listed = listing(spark, sf_dir).where(F.length("source_key") % 4 != 3)
    _, dead = deadletters.replay_ingest(
        dlq, listed, lambda o: ingest.process_objects(o, processed_at=RUN_TS))
    return _stored(spark, dead).select(F.get_json_object("payload", "$.source_key").alias("source_key"),
                       "error_type", "attempt")


NAMES = ("Thnt", "Ertion", "Onthat", "Ndesat", "Reble")     # words of the documents


@query("ingest_names", oracle=f"""WITH n AS (
  SELECT doc_id, len(regexp_extract_all(text, '\\b(?:{'|'.join(NAMES)})\\b')) AS n_name,
         regexp_replace(text, '\\b(?:{'|'.join(NAMES)})\\b', '[REDACTED_NAME]', 'g') AS t FROM documents)
SELECT doc_id, CAST(n_name AS BIGINT) AS n_name, n_name > 0 AS masked, md5(t) AS text_md5 FROM n""")
def ingest_names(spark, sf_dir):
    """J6 -> P9 in ingestion: listed names masked in the row before the patterns run."""
    d = read_documents(spark, sf_dir, ["doc_id", "text"])
    out = redaction.mask_names(d, list(NAMES))
    return out.select("doc_id", "n_name", (F.col("n_name") > 0).alias("masked"), F.md5("text").alias("text_md5"))
