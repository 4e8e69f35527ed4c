"""Streaming (R1-R3): stream ingest equals batch; a restart adds nothing; dedup."""

import os

from docweave.operators import ingest
from docweave.sinks import tables as sinks
from docweave.sources.objects import decode_objects, scan_objects
from docweave.streaming import jobs


def write(root, name, text):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as fh:
        fh.write(text)


def test_stream_ingest_equals_batch_and_restart_is_noop(spark, tmpdir_path):
    root, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    for i in range(6):
        write(root, f"uploads/d{i}.txt", " ".join(f"w{i}_{j}" for j in range(700)) + " a@b.com")
    write(root, "uploads/blank.txt", "  ")
    q = jobs.start_ingest_stream(spark, root, out, f"{out}/_ck", dim=32, max_files_per_trigger=3)
    q.awaitTermination()
    streamed = sinks.read_index(spark, f"{out}/index")
    batch = ingest.chunk_rows(ingest.process_objects(decode_objects(scan_objects(spark, root))))
    key = lambda df: sorted((r.chunk_key, r.text_chunk) for r in df.select("chunk_key", "text_chunk").collect())
    assert key(streamed) == key(batch)
    dlq = spark.read.parquet(f"{out}/dead_letters")
    assert dlq.count() == 1
    q2 = jobs.start_ingest_stream(spark, root, out, f"{out}/_ck", dim=32)
    q2.awaitTermination()
    assert sinks.read_index(spark, f"{out}/index").count() == streamed.count()
    sinks.compact_index(spark, f"{out}/index", f"{out}/compacted")
    assert spark.read.parquet(f"{out}/index_manifest").count() == 6
    assert key(sinks.read_index(spark, f"{out}/compacted")) == key(batch)


def test_stream_dedup(spark, tmpdir_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(50)]
    df = spark.createDataFrame(rows + rows[:10], "event_id long, ts string")
    df.selectExpr("event_id", "cast(ts as timestamp) as ts").write.parquet(f"{tmpdir_path}/ev")
    s = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmpdir_path}/ev")
    d = jobs.dedupe(s, ["event_id"], "ts", "1 day")
    q = d.writeStream.format("memory").queryName("dedup_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from dedup_t").first()[0] == 50


def test_two_streams_share_an_index_and_neither_loses_rows(spark, tmpdir_path):
    out = f"{tmpdir_path}/out"
    for name in "ab":
        write(f"{tmpdir_path}/{name}", f"uploads/{name}.txt", f"text of {name}")
        write(f"{tmpdir_path}/{name}", f"uploads/{name}.bin.txt", "  ")
        for _ in range(2):                       # a restart adds nothing
            jobs.start_ingest_stream(spark, f"{tmpdir_path}/{name}", out, f"{out}/_ck_{name}",
                                     dim=16).awaitTermination()
    docs = sorted(r.source_document for r in sinks.read_index(spark, f"{out}/index").collect())
    assert docs == ["uploads/a.txt", "uploads/b.txt"]
    for table, rows in (("manifest", 4), ("dead_letters", 2), ("index_manifest", 2)):
        assert spark.read.parquet(f"{out}/{table}").count() == rows
    assert sinks.read_processed_documents(spark, f"{out}/processed").count() == 2
    jobs.start_ingest_stream(spark, f"{tmpdir_path}/b", out, f"{out}/_ck_new", dim=16).awaitTermination()
    assert sinks.read_index(spark, f"{out}/index").count() == 2      # the newest generation of each
    assert spark.read.parquet(f"{out}/manifest").count() == 6


def test_micro_batches_are_bounded_by_bytes_not_by_files(spark, tmpdir_path):
    root, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    for i in range(12):
        write(root, f"uploads/d{i}.txt", f"w{i} " * 100)        # some 300 to 400 bytes each
    jobs.start_ingest_stream(spark, root, out, f"{out}/_ck", dim=16,
                             max_bytes_per_trigger=2000).awaitTermination()
    batches = len([f for f in os.listdir(f"{out}/_ck/commits") if f.isdigit()])
    assert 2 <= batches <= 4
    assert sinks.read_index(spark, f"{out}/index").count() == 12


def test_objects_of_one_id_are_one_file_and_written_by_many_tasks(spark, tmpdir_path):
    from docweave.plans import q_streaming
    rows = [(i % 40, f"t{i}") for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(
        f"{tmpdir_path}/documents.parquet")
    root = q_streaming._object_files(spark, tmpdir_path).removeprefix("file:")
    files = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".txt")]
    assert len(files) == 40 and len({os.path.basename(f).split("-")[1] for f in files}) > 1
    assert all(len(open(f).read().split()) == 2 for f in files)


def test_objects_are_plain_files_with_what_the_text_sink_writes(spark, tmpdir_path):
    from docweave.plans import q_streaming
    rows = [(1, "one\ntwo"), (2, "caf\u00e9"), (2, None), (3, None), (-4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    root = q_streaming._object_files(spark, tmpdir_path).removeprefix("file:")
    files = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs]
    assert len(files) == 4 and all(f.endswith(".txt") for f in files)      # no checksum files
    got = {f.rpartition("doc_id=")[2]: open(f, "rb").read() for f in files}
    assert sorted(got.pop("2.txt").split(b"\n")) == [b"", b"", "caf\u00e9".encode()]
    assert got == {"1.txt": b"one\ntwo\n", "3.txt": b"\n", "-4.txt": b"x\n"}


def test_a_micro_batch_has_few_tasks_and_embeds_a_chunk_once(spark, tmpdir_path):
    import glob

    import pandas as pd

    root, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    for i in range(30):
        write(root, f"uploads/d{i}.txt", f"text number {i}")
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")               # a task of the scan an object
    spark.conf.unset(jobs.LISTING_TASKS)
    try:
        jobs.start_ingest_stream(spark, root, out, f"{out}/_ck", dim=16,
                                 max_bytes_per_trigger=1 << 20).awaitTermination()
        assert int(spark.conf.get(jobs.LISTING_TASKS)) == 4 * spark.sparkContext.defaultParallelism
        assert spark.conf.get(jobs.LISTINGS_KEPT) == "0"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", given)
    assert sinks.read_index(spark, f"{out}/index").count() == 30
    assert len(glob.glob(f"{out}/index/write_id=b*/*.parquet")) <= 2 * spark.sparkContext.defaultParallelism

    seen = f"{tmpdir_path}/seen"

    def model(texts):
        with open(seen, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return pd.Series([[1.0] * 16 if "7" not in t else [1.0] for t in texts])

    batch = spark.createDataFrame([("b", f"uploads/d{i}.txt", bytearray(f"text number {i}".encode()))
                                   for i in range(9)], "bucket string, source_key string, content binary")
    jobs.ingest_batch(batch, 0, f"{tmpdir_path}/more", "s", 16, model)
    assert sorted(open(seen).read().splitlines()) == [f"text number {i}" for i in range(9)]
    man = spark.read.parquet(f"{tmpdir_path}/more/index_manifest")
    assert sorted(r.status for r in man.collect()) == ["FAILED"] + ["SUCCESS"] * 8
    assert spark.read.parquet(f"{tmpdir_path}/more/dead_letters").where("stage = 'index'").count() == 1


def test_ingested_objects_can_be_deleted(spark, tmpdir_path):
    root, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    for i in range(6):
        write(root, f"uploads/d{i}.txt", f"w{i} " * 100)
    jobs.start_ingest_stream(spark, root, out, f"{out}/_ck", dim=16, max_files_per_trigger=1,
                             clean_source="delete").awaitTermination()
    assert sinks.read_index(spark, f"{out}/index").count() == 6
    assert len(os.listdir(f"{root}/uploads")) < 6
