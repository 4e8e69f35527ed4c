"""Structured Streaming forms of the pipeline: R1, R2, R3, R9 and streaming R4/R6.

The streaming jobs call the very same DataFrame functions as the batch jobs. Outputs
are idempotent per micro-batch: a batch writes into ``.../stream=<id>/batch_id=<n>`` with
overwrite (index rows included; readers take the newest generation of each document), so a
batch replayed after a failure (same id, same input, from the checkpoint) replaces its own
output instead of adding to it, and each batch costs in proportion to its own size. The
stream's id is the one that Spark keeps in the checkpoint: streams with checkpoints of their
own can share the outputs, and a stream begun again with a new checkpoint adds to them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import answering, deadletters, embedding, ingest, metrics, routing
from docweave.sinks import tables as sinks
from docweave.sources.objects import OBJECT_GLOB, decode_objects

# Of the job that lists a micro-batch's objects once more: Spark gives it up to 10,000.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Of the listings that the driver keeps (250 MB): no other batch asks for a micro-batch's objects.
LISTINGS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"
TASK_BYTES = 16 << 20       # of a micro-batch's objects in a task


def object_stream(spark: SparkSession, root: str, glob: str = OBJECT_GLOB,
                  max_files_per_trigger: int | None = None, bucket: str = C.DEFAULT_BUCKET,
                  max_bytes_per_trigger: int | None = None, clean_source: str | None = None) -> DataFrame:
    """New objects under ``root`` as they arrive (each file once; an overwritten file
    with the same path is not re-read -- use the batch J9 listing diff for that). A micro-batch
    is bounded by a number of files or of bytes: with small objects a number of files makes
    many batches, each with the cost of its writes. ``clean_source="delete"`` deletes the objects
    of a micro-batch once a later one has begun."""
    r = (spark.readStream.format("binaryFile")
         .schema("path string, modificationTime timestamp, length long, content binary")
         .option("recursiveFileLookup", "true").option("pathGlobFilter", glob))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if clean_source:
        r = r.option("cleanSource", clean_source)
    df = r.load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^file:", "")
    key = F.when(rel.startswith(prefix), F.substring(rel, len(prefix) + 1, 1 << 30)).otherwise(rel)
    return df.select(F.lit(bucket).alias("bucket"), key.alias("source_key"),
                     "modificationTime", "length", "content")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that runs from ``checkpoint``: it outlives restarts."""
    line = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(line)["id"]


def ingest_batch(batch: DataFrame, batch_id: int, out: str, stream: str,
                 dim: int = C.EMBED_DIMENSIONS, model_fn=None, tasks: int | None = None) -> None:
    """R2 micro-batch body: route, redact, chunk, embed, index; manifest and dead letters.
    ``stream`` is the id of :func:`stream_id`; ``tasks`` bounds the tasks, and so the files of each
    output: a scan takes no more than some megabytes of *opened* files in a task, a few objects.

    The processed frame and the index rows are persisted for the duration of the batch because
    several outputs read them, and each chunk is embedded once; they are released at the end.
    """
    objs = decode_objects(batch.coalesce(tasks) if tasks else batch)
    own = f"stream={stream}/batch_id={batch_id}"
    processed = ingest.process_objects(objs).persist()
    rows = ingest.index_rows(ingest.embed_chunks(ingest.chunk_rows(processed), dim, model_fn),
                             only_ok=False).persist()
    try:
        sinks.write_processed_documents(ingest.processed_documents(processed),
                                        f"{out}/processed/{own}", mode="overwrite")
        man = ingest.ingest_manifest(processed)
        man.write.mode("overwrite").parquet(f"{out}/manifest/{own}")
        failed = man.where(routing.route_of(F.col("status")) == "DLQ")
        bad = sinks.write_index(rows, f"{out}/index", dim, batch_id, stream)
        dead = deadletters.to_dead_letters(failed, "ingest").unionByName(
            deadletters.to_dead_letters(bad.drop("vector"), "index"))
        dead.write.mode("overwrite").parquet(f"{out}/dead_letters/{own}")
        ingest.index_manifest(embedding.dimension_guard(rows, "vector", dim), dim).write.mode(
            "overwrite").parquet(f"{out}/index_manifest/{own}")
    finally:
        rows.unpersist()
        processed.unpersist()


def start_ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str,
                        dim: int = C.EMBED_DIMENSIONS, available_now: bool = True,
                        max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None,
                        clean_source: str | None = None):
    """R2: streaming ingestion of objects under ``root`` into ``out``. Where micro-batches are
    bounded in bytes, their tasks are in proportion."""
    cores = spark.sparkContext.defaultParallelism
    tasks = max(2 * cores, -(-max_bytes_per_trigger // TASK_BYTES)) if max_bytes_per_trigger else None
    stream = object_stream(spark, root, max_files_per_trigger=max_files_per_trigger,
                           max_bytes_per_trigger=max_bytes_per_trigger, clean_source=clean_source)
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: ingest_batch(
             df, bid, out, stream_id(df.sparkSession, checkpoint), dim, tasks=tasks)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    for key, value in ((LISTING_TASKS, 4 * cores), (LISTINGS_KEPT, 0)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))     # read by every micro-batch, so it stays
    return w.start()


def dedupe(stream: DataFrame, keys: list[str], ts_col: str, delay: str) -> DataFrame:
    """Drop repeated events (same ``keys``) arriving within the watermark delay.
    Rows later than the watermark are dropped: choose ``delay`` above the real disorder."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return s.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def latency_dashboard(stream: DataFrame, ts_col: str, stage_col: str, ms_col: str,
                      window: str = "1 hour", delay: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Per-window, per-stage approximate p50/p90/p99 (emitted once a window closes)."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    g = s.groupBy(F.window(ts_col, window).alias("w"), stage_col).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.percentile_approx(ms_col, p, accuracy).alias(f"{n}_ms") for n, p in metrics.PCTS.items()])
    return g.select(F.col("w.start").alias("window_start"), stage_col, "count",
                    *[f"{n}_ms" for n in metrics.PCTS])


def quota_stream(stream: DataFrame, key_col: str, ts_col: str, delay: str = "1 hour",
                 limit: int = C.DAILY_QUOTA) -> DataFrame:
    """R4 streaming: daily counts per key; append mode emits a day once it is closed."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return metrics.quota_daily(s, key_col, ts_col, limit)


def session_stream(stream: DataFrame, key_col: str, ts_col: str, gap: str = "30 minutes",
                   delay: str = "1 hour") -> DataFrame:
    """R6 streaming: per-key sessions, emitted when the watermark passes the session end."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    # streaming state merges sessions incrementally; one session_window aggregation
    g = s.groupBy(key_col, F.session_window(ts_col, gap).alias("s")).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"))
    return g.select(key_col, F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "requests")


def searchable_delays(processed: DataFrame, indexed: DataFrame, within: str = "1 hour",
                      delay: str = "10 minutes") -> DataFrame:
    """A12 streaming: when each processed document became searchable.

    ``processed(source_bucket, source_document, processed_at)`` meets ``indexed(source_bucket,
    source_document, timestamp)`` in a stream-stream join bounded by ``within``; an index
    generation counts once, however many chunks it has. Returns the document's columns with
    ``indexed_at`` and ``seconds``. A document that no generation follows within the bound comes
    out with nulls, once both streams' watermarks (``delay`` behind them) have passed it."""
    p = processed.select("source_bucket", "source_document", F.col("processed_at").cast("timestamp")) \
                 .withWatermark("processed_at", delay).alias("p")
    i = (indexed.select("source_bucket", "source_document", F.col("timestamp").cast("timestamp").alias("indexed_at"))
         .withWatermark("indexed_at", delay)
         .dropDuplicatesWithinWatermark(["source_bucket", "source_document", "indexed_at"]).alias("i"))
    bound = F.expr(f"i.indexed_at BETWEEN p.processed_at AND p.processed_at + INTERVAL {within}")
    same = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in ("source_bucket", "source_document")]
    seconds = F.unix_seconds("i.indexed_at") - F.unix_seconds("p.processed_at")
    return p.join(i, same[0] & same[1] & bound, "left_outer").select(
        "p.source_bucket", "p.source_document", "p.processed_at", "i.indexed_at", seconds.alias("seconds"))


def answer_batch(batch: DataFrame, batch_id: int, index_path: str, out: str, stream: str,
                 dim: int = C.EMBED_DIMENSIONS, **options) -> None:
    """E2 micro-batch body: the requests answered from the index as it is now."""
    index = sinks.read_index(batch.sparkSession, index_path)
    answering.answer_requests(batch, index, dim, **options).write.mode("overwrite").json(
        f"{out}/stream={stream}/batch_id={batch_id}")


def start_answer_stream(requests: DataFrame, index_path: str, out: str, checkpoint: str,
                        dim: int = C.EMBED_DIMENSIONS, available_now: bool = True, **options):
    """A stream of question requests answered from the stored index into ``out``. Each
    micro-batch reads one snapshot of the index and replaces its own responses when replayed, so a
    request is answered once."""
    w = (requests.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: answer_batch(
             df, bid, index_path, out, stream_id(df.sparkSession, checkpoint), dim, **options)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
