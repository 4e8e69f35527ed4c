"""E1 batch ingestion and its manifests: A4, A5, J9, J10, K1 payload, T4 composition.

The per-object work (route, redact, tokenize, cut) is one narrow stage: each object's
text is processed inside its row and chunks are an array column of that row, so
nothing is grouped to build the processed document. Only the index manifest aggregates
(per document, with map-side partial counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T
from docweave.operators import chunking, embedding, redaction, routing


def chunk_key(source_bucket, source_document, chunk_id):
    """Deterministic index key (fixes duplicate indexing on re-runs); objects of one key in
    two buckets have different keys."""
    return F.sha2(F.concat(source_bucket, F.lit(":"), source_document, F.lit(":"),
                           chunk_id.cast("string")), 256)


def process_objects(objects: DataFrame, size: int = C.CHUNK_SIZE_TOKENS,
                    overlap: int = C.CHUNK_OVERLAP_TOKENS,
                    processed_at: str | None = None, names: list[str] | None = None,
                    detector=None) -> DataFrame:
    """Route, redact and tokenize every object; one row per object.

    Input: ``bucket, source_key, text`` (+ optional ``extract_error``). Output adds
    ``status, reason, error_type, error_message, processed_key, pii counts``, the redacted
    token array ``_tokens`` (empty unless SUCCESS) and ``chunk_count``. Chunks are cut
    from ``_tokens`` by :func:`processed_documents` (nested) or :func:`chunk_rows` (flat).

    ``names`` (a bounded list) and ``detector`` (a column expression of the text giving
    detector spans, e.g. :func:`segmentation.detect`'s result) are masked before the
    patterns run and the text is cut; their labels count like the patterns' own.
    """
    step = chunking.validate_chunk_params(size, overlap)
    routed = routing.route_objects(objects)
    ok = F.col("status") == routing.SUCCESS
    # non-SUCCESS rows carry no text into the regex work
    routed = routed.withColumn("text", F.when(ok, F.col("text")))
    extra = []
    if detector is not None:
        spans = F.coalesce(detector(F.col("text")), F.array().cast(redaction.SPANS_TYPE))
        routed = (routed.withColumn("_spans", spans)
                  .withColumn("_span_counts", redaction.span_label_counts(F.col("_spans")))
                  .withColumn("text", redaction.splice_spans(F.col("text"), F.col("_spans"))).drop("_spans"))
        extra.append(F.col("_span_counts"))
    if names:
        routed = redaction.mask_names(routed, names)
        extra.append(F.when(F.col("n_name") > 0, F.create_map(F.lit("NAME"), F.col("n_name").cast("int")))
                     .otherwise(F.create_map().cast("map<string,int>")))
    red = redaction.redact_documents(routed, "text", "redacted_text")
    for more in extra:
        both = F.map_concat(F.map_filter("pii_entity_counts", lambda k, v: ~F.map_contains_key(more, k)),
                            F.map_zip_with(more, F.map_filter("pii_entity_counts", lambda k, v: F.map_contains_key(more, k)),
                                           lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
        red = red.withColumn("pii_entity_counts", both)
    if extra:
        red = red.withColumn("pii_masked_flag", F.col("pii_masked_flag") | (F.size("pii_entity_counts") > 0))
    ts = F.to_timestamp(F.lit(processed_at)) if processed_at else F.current_timestamp()
    red = red.withColumn("_tokens", F.when(ok, T.tokens(F.col("redacted_text")))
                         .otherwise(F.array().cast("array<string>")))
    out = red.select("*", T.processed_key("source_key").alias("processed_key"),
                     ts.alias("processed_at"))
    n_chunks = F.size(chunking.chunk_starts(F.size("_tokens"), size, step))
    return out.withColumn("chunk_count", n_chunks.cast("int")).drop("redacted_text") \
              .withColumn("_chunk_size", F.lit(size)).withColumn("_chunk_step", F.lit(step))


def processed_documents(processed: DataFrame, size: int = C.CHUNK_SIZE_TOKENS,
                        overlap: int = C.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """K1 payload: the nested per-source record (chunks array built in-row), SUCCESS only."""
    step = chunking.validate_chunk_params(size, overlap)
    return processed.where(F.col("status") == routing.SUCCESS).select(
        F.col("source_key").alias("source_document"), F.col("bucket").alias("source_bucket"),
        "processed_at", "pii_masked_flag", "pii_entity_counts",
        F.col("chunk_count").cast("int").alias("chunk_count"),
        F.lit(size).alias("chunk_size_tokens"), F.lit(overlap).alias("chunk_overlap_tokens"),
        chunking.chunk_struct_array("_tokens", size, step).alias("chunks"), "processed_key")


def ingest_manifest(processed: DataFrame) -> DataFrame:
    """A4: one status row per object (counts and flags only for SUCCESS)."""
    ok = F.col("status") == routing.SUCCESS
    return processed.select(
        "status", "bucket", "source_key",
        F.when(ok, F.col("processed_key")).alias("processed_key"),
        F.when(ok, F.col("chunk_count")).cast("int").alias("chunk_count"),
        F.when(ok, F.col("pii_masked_flag")).alias("pii_masked_flag"),
        F.when(ok, F.col("pii_entity_counts")).alias("pii_entity_counts"),
        "reason", "error_type", "error_message")


def chunk_rows(processed: DataFrame, size: int = C.CHUNK_SIZE_TOKENS,
               overlap: int = C.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """T4: one row per chunk of each SUCCESS object: explode the chunk index sequence
    and slice the token array (narrow; no lambda-built struct array is exploded)."""
    ok = processed.where(F.col("status") == routing.SUCCESS).select(
        F.col("source_key").alias("source_document"), F.col("bucket").alias("source_bucket"),
        "pii_masked_flag", "processed_key", "_tokens")
    ch = chunking.chunk_documents(ok, "_tokens", size, overlap, pre_tokenized=True,
                                  keep=["source_document", "source_bucket", "pii_masked_flag",
                                        "processed_key"])
    return ch.select(chunk_key(F.col("source_bucket"), F.col("source_document"), F.col("chunk_id")).alias("chunk_key"), "*")


def explode_processed(docs: DataFrame) -> DataFrame:
    """S3: one row per chunk of processed documents read back from storage."""
    e = docs.select("source_document", "source_bucket", "pii_masked_flag",
                    "processed_key", F.explode("chunks").alias("c"))
    return e.select(
        chunk_key(F.col("source_bucket"), F.col("source_document"), F.col("c.chunk_id")).alias("chunk_key"),
        "source_document", "source_bucket", "pii_masked_flag", "processed_key",
        F.col("c.chunk_id").alias("chunk_id"), F.col("c.text_chunk").alias("text_chunk"),
        F.col("c.token_count").alias("token_count"), F.col("c.start_token").alias("start_token"),
        F.col("c.end_token").alias("end_token"))


def embed_chunks(chunks: DataFrame, dim: int = C.EMBED_DIMENSIONS, model_fn=None,
                 status_only: bool = False) -> DataFrame:
    """F4 + T3 + F10: skip blank chunks, embed the rest, flag wrong/missing vectors.

    ``status_only`` (hashing embedder only) adds just ``embed_status`` -- enough for the
    index manifest -- without building the vectors."""
    live = chunks.where(F.col("token_count") > 0)
    if status_only and model_fn is None:
        return live.withColumn("embed_status", embedding.hash_embed_status(F.col("text_chunk"), dim))
    emb = embedding.embed(live, "text_chunk", "vector", dim, model_fn)
    return embedding.dimension_guard(emb, "vector", dim)


def index_manifest(embedded: DataFrame, dim: int = C.EMBED_DIMENSIONS,
                   index_name: str = "rag-chunks") -> DataFrame:
    """A5 (+ X5 fix): per processed document, indexed and failed chunk counts and a status
    of SUCCESS, PARTIAL (some failed) or FAILED (none indexed)."""
    g = embedded.groupBy("source_document", "processed_key", "source_bucket").agg(
        F.count_if(F.col("embed_status") == "OK").cast("int").alias("indexed_count"),
        F.count_if(F.col("embed_status") != "OK").cast("int").alias("failed_count"),
        F.max(F.col("pii_masked_flag").cast("int")).cast("boolean").alias("pii_masked_flag"))
    status = (F.when(F.col("indexed_count") == 0, F.lit("FAILED"))
              .when(F.col("failed_count") > 0, F.lit("PARTIAL")).otherwise(F.lit("SUCCESS")))
    return g.select(status.alias("status"), F.col("source_bucket").alias("bucket"),
                    "processed_key", "source_document", F.lit(index_name).alias("index_name"),
                    "indexed_count", "failed_count", F.lit(C.EMBED_MODEL_ID).alias("embed_model_id"),
                    F.lit(dim).alias("embed_dimensions"), "pii_masked_flag")


def index_rows(embedded: DataFrame, timestamp: str | None = None, only_ok: bool = True) -> DataFrame:
    """K2 payload: vector index rows (vector stored as ARRAY<FLOAT>), OK vectors only unless
    the sink is to report the others."""
    ts = F.to_timestamp(F.lit(timestamp)) if timestamp else F.current_timestamp()
    return (embedded.where(F.col("embed_status") == "OK") if only_ok else embedded).select(
        "chunk_key", F.col("vector").cast("array<float>").alias("vector"), "text_chunk",
        "source_bucket", "source_document", ts.alias("timestamp"), "pii_masked_flag",
        F.col("chunk_id").cast("int").alias("chunk_id"), "processed_key")


def new_objects(listing: DataFrame, manifest: DataFrame, key_col: str = "source_key",
                time_col: str | None = None) -> DataFrame:
    """Objects not in the manifest yet, or (with ``time_col``) modified since.
    A left-anti equi-join; Spark/AQE pick broadcast or sort-merge from runtime sizes."""
    keys = [key_col] + ([time_col] if time_col else [])
    return listing.join(manifest.select(*keys).distinct(), keys, "left_anti")


def reconcile(ingest_man: DataFrame, index_man: DataFrame) -> DataFrame:
    """Chunks written vs chunks indexed per source document (full outer join)."""
    a = ingest_man.where(F.col("status") == routing.SUCCESS).select(
        F.col("source_key").alias("source_document"), F.col("chunk_count").alias("chunks_written"))
    b = index_man.select("source_document", F.col("indexed_count").alias("chunks_indexed"))
    j = a.join(b, "source_document", "full_outer")
    w, i = F.coalesce(F.col("chunks_written"), F.lit(0)), F.coalesce(F.col("chunks_indexed"), F.lit(0))
    return j.select("source_document", w.alias("chunks_written"), i.alias("chunks_indexed"),
                    (w - i).alias("missing"),
                    F.when(w == i, F.lit("OK")).when(i < w, F.lit("MISSING"))
                     .otherwise(F.lit("EXTRA")).alias("reconcile_status"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """Order-free digest of each document's set of chunks: their number and the exclusive or of
    128 hash bits of their keys. Combined before the shuffle, one row per document after it."""
    key = F.col("chunk_key")
    return chunks.groupBy("source_bucket", "source_document").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(key)).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(7), key)).alias("b"))


def reconcile_chunks(written: DataFrame, indexed: DataFrame) -> DataFrame:
    """J10 by chunk: ``source_bucket, source_document, chunk_id, difference`` (MISSING: written
    but not indexed; EXTRA: the reverse; REPEATED: in the index more than once).

    Both take ``chunk_key, source_bucket, source_document, chunk_id``. Documents are compared by
    digest first; only those that differ are joined chunk by chunk."""
    doc, keys = ["source_bucket", "source_document"], ["chunk_key", "source_bucket", "source_document", "chunk_id"]
    a, b = chunk_digests(written).alias("a"), chunk_digests(indexed).alias("b")
    same = F.col("a.source_bucket").eqNullSafe(F.col("b.source_bucket")) & F.col(
        "a.source_document").eqNullSafe(F.col("b.source_document"))
    alike = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.a").eqNullSafe(F.col("b.a")) & F.col(
        "a.b").eqNullSafe(F.col("b.b"))
    differ = a.join(b, same, "full_outer").where(~alike).select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(f"_{c}") for c in doc]).checkpoint()

    def only(chunks: DataFrame, side: str) -> DataFrame:
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in doc]
        kept = chunks.select(*keys).join(differ, on[0] & on[1], "left_semi")
        return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).withColumn("side", F.lit(side))

    both = only(written, "w").unionByName(only(indexed, "i")).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "w", F.col("times"))).alias("w"),
        F.max(F.when(F.col("side") == "i", F.col("times"))).alias("i"))
    difference = (F.when(F.col("i").isNull(), "MISSING").when(F.col("w").isNull(), "EXTRA")
                  .when(F.col("i") > F.col("w"), "REPEATED"))
    return both.select(*doc, "chunk_id", difference.alias("difference")).where("difference is not null")
