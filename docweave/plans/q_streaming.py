"""Streaming queries (R2, R3, R9): each runs a Structured Streaming job to completion
(``availableNow``) over files derived from the supplied tables, then returns the sink
contents as a DataFrame."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.plans import common
from docweave.plans.catalog import query
from docweave.plans.q_metrics import AUDIT_QUOTA, SESSIONS_SQL
from docweave.plans.q_rag import RESPONSES_SQL, question_requests
from docweave.session import scratch_path
from docweave.sources.tables import read_table
from docweave.streaming import jobs

STAGE_SQL = ("CASE event_type WHEN 'click' THEN 'embedding' WHEN 'view' THEN 'retrieval' "
             "WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'total' END")
STREAM_BATCH_BYTES = 64 << 20      # of objects in a micro-batch: the number of batches follows the bytes
DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events_stream(spark, sf_dir, copies: int = 1):
    """The log file as a file stream; ``copies`` > 1 replays it (duplicate deliveries)."""
    def one():
        return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
                .parquet(sf_dir.rstrip("/")))
    out = one()
    for _ in range(copies - 1):
        out = out.unionByName(one())
    return out


def _run_to_parquet(stream_df, spark, name: str, mode: str = "append"):
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    q = (stream_df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(f"{base}/data")


def _run_to_newest(stream_df, spark, name: str, keys: list[str]):
    """Run a windowed aggregation in update mode, each micro-batch's changed rows in a folder
    of its own (a replay replaces it), and read the newest row per key: open windows are
    part of the result and a batch costs what it changed."""
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")

    def store(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{base}/data/batch_id={int(batch_id):012d}")

    q = (stream_df.writeStream.foreachBatch(store).outputMode("update")
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*stream_df.schema.fields, T.StructField("batch_id", T.StringType())])
    rest = [c for c in stream_df.columns if c not in keys]
    newest = (spark.read.schema(schema).parquet(f"{base}/data").groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), "batch_id").alias("r")))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


@query("stream_dedup", oracle="""
SELECT DISTINCT event_id, user_id, event_type, value FROM events""")
def stream_dedup(spark, sf_dir):
    """The log delivered twice, de-duplicated by event id within a 60-day watermark;
    equals the batch distinct set."""
    s = jobs.dedupe(_events_stream(spark, sf_dir, copies=2), ["event_id"], "ts", "60 days")
    out = _run_to_parquet(s.select("event_id", "user_id", "event_type", "value", "ts"), spark, "dedup")
    return out.select("event_id", "user_id", "event_type", "value")


@query("stream_latency_dashboard", oracle=f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {STAGE_SQL} AS stage,
       CAST(count(value) AS BIGINT) AS count, quantile_disc(value, 0.5) AS p50_ms,
       quantile_disc(value, 0.9) AS p90_ms, quantile_disc(value, 0.99) AS p99_ms
FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def stream_latency_dashboard(spark, sf_dir):
    """Hourly latency percentiles per stage from the log stream, open windows included;
    exact while a window has fewer values than the sketch's accuracy."""
    from docweave.operators import metrics as M
    s = _events_stream(spark, sf_dir).where(F.col("event_type") != "error") \
        .withColumn("stage", M.stage_of(F.col("event_type")))
    d = jobs.latency_dashboard(s, "ts", "stage", "value", "1 hour", "1 hour")
    out = _run_to_newest(d, spark, "dashboard", ["window_start", "stage"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_quota_daily", oracle=f"""
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start,
       CAST(count(*) AS BIGINT) AS requests, count(*) > {AUDIT_QUOTA} AS over_quota
FROM events GROUP BY user_id, date_trunc('day', ts)""")
def stream_quota_daily(spark, sf_dir):
    """R4 (streaming): daily request counts per key, the days still open included."""
    d = jobs.quota_stream(_events_stream(spark, sf_dir), "user_id", "ts", "1 hour", AUDIT_QUOTA)
    out = _run_to_newest(d, spark, "quota", ["user_id", "day_start"])
    return out.select("user_id", F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"),
                      "requests", "over_quota")


@query("stream_sessions", oracle=SESSIONS_SQL)
def stream_sessions(spark, sf_dir):
    """R6 (streaming): per-key sessions of the log, emitted as the watermark closes them; a
    later record of no key lets it pass the last ones."""
    base = scratch_path(spark, f"tick-{uuid.uuid4().hex}")
    (read_table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
     .withColumn("user_id", F.lit(None).cast("bigint")).write.parquet(base))
    tick = spark.readStream.schema("ts timestamp_ntz, user_id bigint").parquet(base)
    log = _events_stream(spark, sf_dir).select("ts", "user_id").unionByName(tick)
    out = _run_to_parquet(jobs.session_stream(log, "user_id", "ts"), spark, "sessions")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.where("user_id is not null").select(
        "user_id", F.date_format("session_start", fmt).alias("session_start"),
        F.date_format("session_end", fmt).alias("session_end"), "requests")


def _object_writer(folder):
    """Writes ``(doc_id, text)`` rows sorted by id, an object an id, under ``folder``: what the text
    sink writes of them (a line each). A task that runs again writes its own objects again."""
    def write(batches):
        task = f"part-{TaskContext.get().partitionId():05d}"
        os.makedirs(f"{folder}/{task}", exist_ok=True)
        out, last, n = None, None, 0
        try:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    name = "__HIVE_DEFAULT_PARTITION__" if doc_id is None else doc_id
                    if out is None or name != last:
                        if out is not None:
                            out.close()
                        out, last, n = open(f"{folder}/{task}/{task}-doc_id={name}.txt", "wb"), name, n + 1
                    out.write((text or "").encode("utf-8") + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
    return write


def _object_files(spark, sf_dir):
    """Write every document as one text object, its id in the name. Objects of one id are written
    by one task; all tasks of the cluster write. A folder that the executors mount is written by
    their Python workers: Hadoop's local files cost a process or two and a checksum file each.
    Other stores are written by Spark's text sink, as ``doc_id=<id>/part-*.txt``."""
    base = scratch_path(spark, f"objects-{uuid.uuid4().hex}")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    mounted = re.fullmatch(r"file:(?://)?(/(?!/).*)", f"{base}/uploads")
    if mounted:
        given = spark.conf.get(DROP_SHUFFLE, None)
        spark.conf.set(DROP_SHUFFLE, "true")        # the shuffled texts go when the objects are written
        try:
            (d.sortWithinPartitions("doc_id").mapInArrow(_object_writer(mounted[1]), "n bigint")
             .agg(F.sum("n")).collect())
        finally:
            spark.conf.unset(DROP_SHUFFLE) if given is None else spark.conf.set(DROP_SHUFFLE, given)
    else:
        d.write.partitionBy("doc_id").text(f"{base}/uploads")
    return f"{base}/uploads"


@query("stream_ingest", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT doc_id, chunk_id, token_count, text_chunk FROM chunk_rows""")
def stream_ingest(spark, sf_dir):
    """R1 + R2: documents landed as text objects, ingested by a file stream with
    foreachBatch (route, redact, chunk, embed, upsert); the indexed chunks read back."""
    root = _object_files(spark, sf_dir)
    out = scratch_path(spark, f"stream-ingest-{uuid.uuid4().hex}")
    q = jobs.start_ingest_stream(spark, root, out, f"{out}/_checkpoint", dim=common.TEXT_DIM,
                                 max_bytes_per_trigger=STREAM_BATCH_BYTES, clean_source="delete")
    q.awaitTermination()
    from docweave.sinks import tables as sinks
    idx = sinks.read_index(spark, f"{out}/index")
    doc_id = F.regexp_extract("source_document", r"doc_id=(\d+)[/.]", 1).cast("bigint")
    return idx.select(doc_id.alias("doc_id"), "chunk_id",
                      F.size(F.split("text_chunk", " ")).alias("token_count"), "text_chunk")


@query("stream_time_to_searchable", oracle="""
SELECT 'uploads/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_document,
       CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 90 WHEN 2 THEN 45 END AS seconds,
       CASE doc_id % 4 WHEN 0 THEN 'WITHIN' WHEN 1 THEN 'LATE' WHEN 2 THEN 'WITHIN' ELSE 'NEVER' END AS outcome
FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')""")
def stream_time_to_searchable(spark, sf_dir):
    """The stored processed documents and index rows of four ingestion runs, read as two
    streams and joined by interval; the run whose chunks were not indexed comes out as NEVER."""
    from docweave import constants as C
    from docweave.operators import ingest
    from docweave.schemas import INDEX_ROW, PROCESSED_DOCUMENT
    from docweave.sinks import tables as sinks
    from docweave.sources.tables import source_documents
    base = scratch_path(spark, f"searchable-{uuid.uuid4().hex}")
    docs = source_documents(spark, sf_dir)
    for run, (processed_at, indexed_at) in enumerate((
            ("2024-02-01 00:00:00", "2024-02-01 00:00:20"), ("2024-02-01 06:00:00", "2024-02-01 06:01:30"),
            ("2024-02-01 12:00:00", "2024-02-01 12:00:45"), ("2024-02-01 18:00:00", None))):
        done = ingest.process_objects(docs.where(F.col("doc_id") % 4 == run).select("bucket", "source_key", "text"),
                                      processed_at=processed_at)
        sinks.write_processed_documents(ingest.processed_documents(done), f"{base}/processed", "parquet")
        if indexed_at:
            emb = ingest.embed_chunks(ingest.chunk_rows(done), 16)
            sinks.write_index(ingest.index_rows(emb, indexed_at), f"{base}/index", 16)
    # a later record on both sides lets the watermarks pass the last run
    tick = spark.createDataFrame([("tick", "tick", "2024-02-03 00:00:00")], "b string, d string, t string").select(
        F.col("b").alias("source_bucket"), F.col("d").alias("source_document"), F.to_timestamp("t").alias("t"))
    tick.withColumnRenamed("t", "processed_at").write.mode("append").partitionBy("source_bucket").parquet(
        f"{base}/processed")
    tick.withColumnRenamed("t", "timestamp").write.parquet(f"{base}/index/write_id=tick")
    processed = spark.readStream.schema(PROCESSED_DOCUMENT).parquet(f"{base}/processed")
    indexed = spark.readStream.schema(INDEX_ROW).parquet(f"{base}/index")
    found = _run_to_parquet(jobs.searchable_delays(processed, indexed), spark, "searchable-out")
    outcome = (F.when(F.col("seconds").isNull(), "NEVER")
               .when(F.col("seconds") <= C.TIME_TO_SEARCHABLE_TARGET_S, "WITHIN").otherwise("LATE"))
    return found.where("source_document <> 'tick'").select(
        "source_document", F.col("seconds").cast("int").alias("seconds"), outcome.alias("outcome"))


def _rag_index(spark, sf_dir):
    """The documents' chunks as a stored index."""
    from docweave.operators import embedding, ingest
    from docweave.sinks import tables as sinks
    path = scratch_path(spark, f"rag-index-{uuid.uuid4().hex}")
    rows = common.chunk_rows(spark, sf_dir).withColumn("source_bucket", F.lit("documents"))
    emb = embedding.dimension_guard(embedding.embed(rows, "text_chunk", "vector", common.TEXT_DIM), "vector",
                                    common.TEXT_DIM)
    sinks.write_index(ingest.index_rows(emb, "2024-02-01 00:00:00"), path, common.TEXT_DIM)
    return path


@query("stream_rag_responses", oracle=RESPONSES_SQL)
def stream_rag_responses(spark, sf_dir):
    """The question requests as a file stream, answered per micro-batch from a stored
    index; the stream is run again from its checkpoint, which adds nothing."""
    base = scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    index = _rag_index(spark, sf_dir)
    requests = question_requests(spark, sf_dir)
    requests.repartition(2).write.parquet(f"{base}/requests")
    for _ in range(2):
        s = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/requests")
        jobs.start_answer_stream(s, index, f"{base}/out", f"{base}/_checkpoint", common.TEXT_DIM).awaitTermination()
    out = spark.read.schema("request_id bigint, status_code int, body string").json(f"{base}/out")

    def field(name):
        return F.get_json_object("body", f"$.{name}").alias(name)

    return out.select("request_id", "status_code", field("answer"), field("error"), field("error_type"))
