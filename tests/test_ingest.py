"""Object scan, routing, manifests, index sink and dead letters on a temporary bucket."""

import json
import os

from pyspark.sql import functions as F

from docweave.operators import ingest, routing
from docweave.sinks import tables as sinks
from docweave.sources.objects import decode_objects, scan_objects


def make_bucket(root):
    files = {"uploads/a b.txt": "Hello 123-45-6789 world", "uploads/b.TXT": "   ",
             "uploads/c.Txt": "x@y.com", "uploads/d.md": "markdown", "processed/f.txt": "old",
             "uploads/e.pdf": "%PDF-1.4"}
    for k, v in files.items():
        p = os.path.join(root, k)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(v)
    return files


def test_scan_route_and_manifest(spark, tmpdir_path):
    make_bucket(tmpdir_path)
    objs = decode_objects(scan_objects(spark, tmpdir_path))
    keys = {r.source_key for r in objs.select("source_key").collect()}
    assert "uploads/d.md" not in keys          # suffix filter applied while listing
    assert "uploads/c.Txt" not in keys         # only the four accepted spellings are listed
    man = {r.source_key: r for r in ingest.ingest_manifest(ingest.process_objects(objs)).collect()}
    assert man["uploads/a b.txt"].status == "SUCCESS" and man["uploads/a b.txt"].chunk_count == 1
    assert dict(man["uploads/a b.txt"].pii_entity_counts) == {"SSN": 1}
    assert man["uploads/b.TXT"].status == "FAILED" and man["uploads/b.TXT"].error_message == "Extracted text is empty"
    assert man["processed/f.txt"].status == "SKIPPED"
    assert man["uploads/e.pdf"].status == "FAILED" and man["uploads/e.pdf"].error_type == "RuntimeError"


def test_routing_order_skips_processed_before_extension(spark):
    df = spark.createDataFrame([("processed/x/chunks.json", "{}"), ("a.json", "x")], "source_key string, text string")
    got = {r.source_key: r.status for r in routing.route_objects(df).collect()}
    assert got == {"processed/x/chunks.json": "SKIPPED", "a.json": "FAILED"}


def index_rows(spark, ts):
    df = spark.createDataFrame([("uploads/a.txt", "bucket", "alpha beta gamma " * 5)],
                               "source_key string, bucket string, text string")
    p = ingest.process_objects(df, size=4, overlap=1)
    emb = ingest.embed_chunks(ingest.chunk_rows(p, 4, 1), 16)
    return ingest.index_rows(emb, ts), ingest.index_manifest(emb, 16)


def test_index_upsert_is_idempotent_and_append_duplicates(spark, tmpdir_path):
    rows1, man = index_rows(spark, "2024-01-01 00:00:00")
    n = rows1.count()
    assert man.first().status == "SUCCESS" and man.first().indexed_count == n
    ix = f"{tmpdir_path}/ix"
    for ts in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        rows, _ = index_rows(spark, ts)
        assert sinks.write_index(rows, ix, 16).count() == 0
    latest = sinks.read_index(spark, ix)
    assert latest.count() == n and latest.agg(F.min("timestamp")).first()[0].day == 2
    assert sinks.read_index(spark, ix, latest=False).count() == 2 * n
    rows, _ = index_rows(spark, "2024-01-02 00:00:00")          # an equal time: one write wins
    sinks.write_index(rows, ix, 16)
    assert sinks.read_index(spark, ix).count() == n
    shorter = rows.where("chunk_id = 0").withColumn("timestamp", F.to_timestamp(F.lit("2024-01-03 00:00:00")))
    sinks.write_index(shorter, ix, 16)                          # stale chunks are gone
    assert {r.chunk_id for r in sinks.read_index(spark, ix).collect()} == {0}
    other = shorter.withColumn("source_bucket", F.lit("elsewhere"))
    sinks.write_index(other, ix, 16)                            # a bucket of its own
    assert sinks.read_index(spark, ix).count() == 2 * shorter.count()


def test_index_refuses_wrong_dimension(spark, tmpdir_path):
    rows, _ = index_rows(spark, "2024-01-01 00:00:00")
    bad = sinks.write_index(rows, f"{tmpdir_path}/ix", dim=32)
    assert {r.error_message for r in bad.collect()} == {"unexpected vector width 16"}
    assert sinks.read_index(spark, f"{tmpdir_path}/ix").count() == 0


def test_reconcile_flags_missing_chunks(spark):
    man = spark.createDataFrame([("SUCCESS", "d1", 3), ("SUCCESS", "d2", 2)],
                                "status string, source_key string, chunk_count int")
    idx = spark.createDataFrame([("d1", 3), ("d2", 1)], "source_document string, indexed_count int")
    got = {r.source_document: r.reconcile_status for r in ingest.reconcile(man, idx).collect()}
    assert got == {"d1": "OK", "d2": "MISSING"}


def test_processed_documents_rewrite_keeps_other_sources(spark, tmpdir_path):
    def run(keys, ts):
        df = spark.createDataFrame([("b", k, f"text of {k} at {ts}") for k in keys],
                                   "bucket string, source_key string, text string")
        return ingest.processed_documents(ingest.process_objects(df, processed_at=ts))
    path = f"{tmpdir_path}/processed"
    sinks.write_processed_documents(run(["a.txt", "b.txt"], "2024-01-01 00:00:00"), path)
    for _ in range(2):                                          # a record stored twice alike is one
        sinks.write_processed_documents(run(["b.txt"], "2024-01-02 00:00:00"), path)
    assert sinks.read_processed_documents(spark, path).count() == 2
    assert sinks.read_processed_documents(spark, path, latest=False).count() == 4
    got = {r.source_document: r.chunks[0].text_chunk for r in sinks.read_processed_documents(spark, path).collect()}
    assert got == {"a.txt": "text of a.txt at 2024-01-01 00:00:00", "b.txt": "text of b.txt at 2024-01-02 00:00:00"}


def test_dead_letter_replay_retries_and_gives_up(spark):
    from docweave.operators import deadletters
    objs = spark.createDataFrame([("b", "ok.txt", "now fixed text"), ("b", "still.txt", "  "),
                                  ("b", "old.txt", "  ")], "bucket string, source_key string, text string")
    dlq = spark.createDataFrame([
        ("ingest", '{"bucket": "b", "source_key": "%s"}' % k, a, "E") for k, a in (
            ("ok.txt", 1), ("still.txt", 1), ("still.txt", 2), ("old.txt", 1), ("old.txt", 2),
            ("old.txt", 3), ("gone.txt", 1), ("over.txt", 3))]
        + [("ingest", '{"bucket": "b", "source_key": "over.txt"}', 3, "GIVE_UP")],
        "stage string, payload string, attempt int, error_type string")
    processed, dead = deadletters.replay_ingest(dlq, objs, ingest.process_objects)
    assert {r.source_key: r.status for r in processed.collect()} == {"ok.txt": "SUCCESS", "still.txt": "FAILED"}
    got = {json.loads(r.payload)["source_key"]: (r.error_type, r.attempt) for r in dead.collect()}
    assert dead.count() == 3 and got == {
        "still.txt": ("ValueError", 3), "old.txt": ("GIVE_UP", 3), "gone.txt": ("NOT_LISTED", 2)}
