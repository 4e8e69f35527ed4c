"""Stored sketches, the nested report, reconciliation by digests, streamed joins and answers."""

import random

import numpy as np
import pytest
from docweave.operators import ingest, metrics, sketches
from docweave.sinks import tables as sinks
from docweave.streaming import jobs
from pyspark.sql import functions as F


def test_day_quantiles_from_hour_sketches_keep_the_rank_bound(spark, tmpdir_path):
    rng = np.random.default_rng(1)
    n = 40_000
    rows = [(f"2024-01-0{1 + int(d)} {int(h):02d}:10:00", "s" if i % 3 else "t", float(v)) for i, (d, h, v) in enumerate(
        zip(rng.integers(0, 2, n), rng.integers(0, 24, n), rng.lognormal(3, 1, n)))]
    log = spark.createDataFrame(rows + [("2024-01-01 00:00:00", "s", None)], "ts string, g string, v double") \
        .withColumn("ts", F.to_timestamp("ts"))
    path = f"{tmpdir_path}/sk"
    made = sketches.sketch(log, ["g"], "ts", "v", k=200)
    for _ in range(2):                                      # a day written again replaces itself
        sketches.write_sketches(made, path)
    day = F.to_date("slot_start").alias("day")
    found = sketches.merged(sketches.read_sketches(spark, path), [day, "g"], k=200).collect()
    assert len(found) == 4
    for r in found:
        own = np.sort([v for t, g, v in rows if t.startswith(str(r.day)) and g == r.g])
        assert r["count"] == len(own) and r["max"] == own[-1] and r["mean"] == pytest.approx(own.mean())
        for name, p in metrics.PCTS.items():
            rank = np.searchsorted(own, r[name], side="right") / len(own)
            assert abs(rank - p) <= sketches.rank_error(200) + 1 / len(own)
    part = sketches.read_sketches(spark, path, "2024-01-01 06:00:00", "2024-01-02 00:00:00")
    assert part.select("slot_start").distinct().count() == 18


def test_report_is_one_nested_row(spark, tmpdir_path):
    rows = [(True, "total", 10.0, 100, 30), (True, "total", 20.0, 200, 60), (True, "llm", 5.0, 1, 1),
            (False, None, 9.0, 7, 7), (True, "other", 1.0, None, None)]
    df = spark.createDataFrame(rows, "ok boolean, stage string, ms double, input_tokens int, output_tokens int")
    made = metrics.report(df)
    sinks.write_report(made, f"{tmpdir_path}/r")
    r = spark.read.schema(made.schema).json(f"{tmpdir_path}/r").first()
    assert r.summary.asDict() == {"requests": 5, "success": 4, "failed": 1, "input_tokens": 301, "output_tokens": 91}
    assert r.latency["total"].asDict() == {"count": 2, "mean_ms": 15.0, "p50_ms": 15.0, "p90_ms": 19.0,
                                           "p99_ms": 19.9, "max_ms": 20.0}
    assert r.latency["embedding"]["count"] == 0 and r.latency["embedding"].max_ms is None
    assert set(r.latency) == {"embedding", "retrieval", "llm", "total"} and len(r.cost) == 3
    none = metrics.report(df.where("false")).first()
    assert none.summary.requests == 0 and none.cost[0].total_cost_usd == 0


def test_reconcile_names_every_differing_chunk(spark):
    rng = random.Random(3)
    schema = "chunk_key string, source_bucket string, source_document string, chunk_id int"
    written = [(f"k{d}-{c}", None if d == 3 else "b", f"d{d}", c) for d in range(30) for c in range(rng.randint(1, 5))]
    indexed, want = [], set()
    for row in written:
        x = rng.random()
        if x < 0.1:
            want.add((row[2], row[3], "MISSING"))
            continue
        indexed.append(row)
        if x > 0.9:
            indexed.append(row)
            want.add((row[2], row[3], "REPEATED"))
    indexed.append(("new", "b", "d99", 7))
    want.add(("d99", 7, "EXTRA"))
    a, b = (spark.createDataFrame(r, schema) for r in (written, indexed))
    got = {(r.source_document, r.chunk_id, r.difference) for r in ingest.reconcile_chunks(a, b).collect()}
    assert got == want
    assert ingest.reconcile_chunks(a, a).count() == 0
    assert ingest.reconcile_chunks(a.where("false"), b.where("false")).count() == 0


def test_documents_meet_their_index_rows_or_come_out_alone(spark, tmpdir_path):
    def store(name, rows):
        cols = "source_bucket string, source_document string, t string, chunk_id int"
        df = spark.createDataFrame(rows, cols).withColumn("t", F.to_timestamp("t"))
        when = "processed_at" if name == "p" else "timestamp"
        df.withColumnRenamed("t", when).write.mode("append").parquet(f"{tmpdir_path}/{name}")
    day = "2024-03-01 "
    store("p", [("b", "a", day + "00:00:00", 0), ("b", "late", day + "00:00:00", 0), ("b", "never", day + "00:10:00", 0),
                ("c", "a", day + "00:00:00", 0)])
    store("i", [("b", "a", day + "00:00:30", c) for c in range(3)] + [("b", "late", day + "02:00:00", 0),
                                                                  ("b", "stray", day + "00:00:00", 0)])
    for name in "pi":
        store(name, [("x", "tick", "2024-03-02 00:00:00", 0)])

    def run():
        p = spark.readStream.schema("source_bucket string, source_document string, processed_at timestamp").parquet(f"{tmpdir_path}/p")
        i = spark.readStream.schema("source_bucket string, source_document string, timestamp timestamp").parquet(f"{tmpdir_path}/i")
        q = (jobs.searchable_delays(p, i).writeStream.format("parquet").option("path", f"{tmpdir_path}/out")
             .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return {(r.source_bucket, r.source_document): r.seconds for r in spark.read.parquet(f"{tmpdir_path}/out").collect()
                if r.source_bucket != "x"}
    want = {("b", "a"): 30, ("b", "late"): None, ("b", "never"): None, ("c", "a"): None}
    assert run() == want
    assert run() == want                                        # a restart adds nothing
    assert spark.read.parquet(f"{tmpdir_path}/out").where("source_bucket <> 'x'").count() == 4


def test_streamed_answers_are_given_once(spark, tmpdir_path):
    import os
    os.makedirs(f"{tmpdir_path}/in/uploads")
    with open(f"{tmpdir_path}/in/uploads/a.txt", "w") as fh:
        fh.write("the capital of france is paris")
    jobs.start_ingest_stream(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/ix", f"{tmpdir_path}/ck0").awaitTermination()
    schema = "request_id long, is_base64 boolean, body string"
    spark.createDataFrame([(1, False, '{"question": "capital of france"}'), (2, False, "{}"), (3, False, "[]")],
                          schema).write.parquet(f"{tmpdir_path}/q")
    for more in (None, (4, False, '{"question": "zzz qqq"}')):
        if more:
            spark.createDataFrame([more], schema).write.mode("append").parquet(f"{tmpdir_path}/q")
        for _ in range(2):
            s = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/q")
            jobs.start_answer_stream(s, f"{tmpdir_path}/ix/index", f"{tmpdir_path}/out", f"{tmpdir_path}/ck1").awaitTermination()
    out = {r.request_id: r for r in spark.read.schema("request_id long, status_code int, body string")
           .json(f"{tmpdir_path}/out").collect()}
    assert {k: r.status_code for k, r in out.items()} == {1: 200, 2: 400, 3: 500, 4: 200}
    assert "paris" in out[1].body and "paris" not in out[4].body
    assert spark.read.json(f"{tmpdir_path}/out").count() == 4


def test_index_rows_of_the_reconciliation_come_of_one_pass(spark, tmpdir_path, monkeypatch):
    from docweave.plans import q_ops
    rows = [(i, "w " * 600 * (i % 3), "en", "web") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmpdir_path}/pages.parquet")
    plans, inner = [], q_ops.sinks.write_index

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return inner(rows, *rest)

    monkeypatch.setattr(q_ops.sinks, "write_index", watched)
    got = sorted((r.source_document, r.chunk_id, r.difference)
                 for r in q_ops.index_reconcile_chunks(spark, tmpdir_path).collect())
    want = []
    for i, text, _, _ in rows:
        n = len(text.split())
        key, chunks = f"uploads/web/{i}.txt", 0 if not n else 1 + max(0, -(-(n - 500) // 450))
        want += [(key, c, "MISSING") for c in range(chunks) if i % 5 == 0 and c % 3 == 0]
        if chunks:
            want += [(key, 990 + i % 7, "EXTRA")] * (i % 4 == 1)
            want += [(key, 0, "REPEATED")] * (i % 9 == 2 and i % 5 != 0)
    assert got == sorted(want)
    assert plans[0].count("Generate explode") == 2          # chunks of a document, rows of a chunk
