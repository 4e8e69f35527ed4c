"""Plug-in hooks (U2, U3), writers (K3, K5, K6), access log (S5), pages (P2), R6/R9 streams."""

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docweave.operators import embedding, metrics, rag
from docweave.sinks import tables as sinks
from docweave.sources import events as ev
from docweave.sources.objects import assemble_pages
from docweave.streaming import jobs


def test_embedder_hook_runs_per_batch(spark):
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    got = sorted(r.v for r in embedding.embed(df, "t", "v", model_fn=model).collect())
    assert got == [[2.0, 1.0], [4.0, 1.0]]


def test_generator_hook_feeds_response_parser(spark):
    df = spark.createDataFrame([(1, "sys", "q?")], "query_id long, system_prompt string, question string")

    def model(pdf: pd.DataFrame) -> pd.Series:
        return pdf["question"].map(lambda q: json.dumps(
            {"content": [{"type": "text", "text": f"echo {q}"}], "usage": {"input_tokens": 4, "output_tokens": 2}}))
    out = rag.parse_model_response(rag.model_generate(df, model)).first()
    assert out.answer == "echo q?" and out.status_code == 200 and out.output_tokens == 2


def test_ensure_index_is_idempotent(spark, tmpdir_path):
    sinks.ensure_index(spark, f"{tmpdir_path}/ix")
    sinks.ensure_index(spark, f"{tmpdir_path}/ix")
    assert sinks.read_index(spark, f"{tmpdir_path}/ix").count() == 0


def test_report_and_answer_json(spark, tmpdir_path):
    totals = spark.createDataFrame([(50, 50, 0, 9895, 3136)],
                                   "requests long, success long, failed long, input_tokens long, output_tokens long")
    report = totals.select(F.struct("*").alias("summary"),
                           F.array(*[F.struct(F.lit(m).alias("model")) for m, _, _ in [("a", 0, 0)]]).alias("cost"))
    sinks.write_report(report, f"{tmpdir_path}/report")
    files = [f for f in os.listdir(f"{tmpdir_path}/report") if f.endswith(".json")]
    assert len(files) == 1
    rec = spark.createDataFrame(
        [(1, 200, "ans", [], 0, "m", "e", (1, 2), (None, None, None, None)),
         (2, 500, None, [], 0, "m", "e", (0, 0), (None, None, None, None))],
        "query_id long, status_code int, answer string, sources array<struct<rank:int>>, "
        "retrieved_count int, model_id string, embed_model_id string, "
        "usage struct<input_tokens:int,output_tokens:int>, "
        "latency_ms struct<embedding:double,retrieval:double,llm:double,total:double>")
    bodies = {r.query_id: json.loads(r.body) for r in sinks.answer_json(rec).collect()}
    assert bodies[1]["answer"] == "ans" and bodies[2]["error"] == "RAG query failed"
    assert set(bodies[2]) == {"error", "error_type", "error_message"}
    bad = rec.where("query_id = 2").withColumn("status_code", F.lit(400))
    assert json.loads(sinks.answer_json(bad).first().body) == {"error": "Missing required field: question"}


def test_access_log_reader(spark, tmpdir_path):
    rec = {"requestId": "r1", "ip": "1.2.3.4", "caller": "-", "user": "-",
           "requestTime": "01/Jan/2024:10:00:00 +0000", "httpMethod": "POST", "resourcePath": "/query",
           "status": "200", "protocol": "HTTP/1.1", "responseLength": "10", "apiKeyId": "k"}
    os.makedirs(f"{tmpdir_path}/log")
    with open(f"{tmpdir_path}/log/a.json", "w") as fh:
        fh.write(json.dumps(rec) + "\n" + json.dumps({**rec, "requestTime": "garbage"}) + "\n")
    rows = ev.read_access_log(spark, f"{tmpdir_path}/log").orderBy("requestTime").collect()
    assert rows[0].request_ts.hour == 10 and rows[1].request_ts is None


def test_page_assembly_omits_failed_pages_and_keeps_empty(spark):
    pages = spark.createDataFrame([(1, 0, "p0", False), (1, 1, None, False), (1, 2, "bad", True), (1, 3, "p3", False)],
                                  "doc_id long, page_no long, text string, failed boolean")
    got = assemble_pages(pages, failed_col="failed").first()
    assert got.text == "p0\n\np3" and got.page_count == 3


def _stream(spark, tmpdir_path, rows):
    df = spark.createDataFrame(rows, "k long, ts string, v double")
    df.selectExpr("k", "cast(ts as timestamp) as ts", "v").write.parquet(f"{tmpdir_path}/s")
    return spark.readStream.schema("k long, ts timestamp, v double").parquet(f"{tmpdir_path}/s")


def test_streaming_sessions_and_dashboard_match_batch(spark, tmpdir_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 01:00:00", 3.0),
            (2, "2024-01-01 00:05:00", 4.0), (1, "2024-01-03 00:00:00", 5.0)]
    s = _stream(spark, tmpdir_path, rows)
    q = jobs.session_stream(s, "k", "ts", "30 minutes", "1 minute").writeStream.format("memory") \
        .queryName("sess_t").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{tmpdir_path}/s")
    closed = {(r.k, str(r.session_start)) for r in spark.sql("select * from sess_t").collect()}
    allb = {(r.k, str(r.session_start)) for r in metrics.sessions(batch, "k", "ts").collect()}
    assert closed and closed <= allb        # closed sessions equal their batch twins
    d = jobs.latency_dashboard(s.withColumn("stage", F.lit("total")), "ts", "stage", "v", "1 hour", "1 minute")
    q2 = d.writeStream.format("memory").queryName("dash_t").outputMode("append").trigger(availableNow=True).start()
    q2.awaitTermination()
    assert spark.sql("select count(*) from dash_t").first()[0] >= 1


def test_dead_letters_written_with_declared_schema(spark, tmpdir_path):
    from docweave.operators import deadletters
    failed = spark.createDataFrame([("a.md", "ValueError", "Unsupported object key extension: a.md")],
                                   "source_key string, error_type string, error_message string")
    dlq = deadletters.to_dead_letters(failed, "ingest", F.to_timestamp(F.lit("2024-01-05 10:00:00")))
    sinks.append_dead_letters(dlq, f"{tmpdir_path}/dlq")
    back = spark.read.parquet(f"{tmpdir_path}/dlq").first()
    assert back.stage == "ingest" and back.attempt == 1 and json.loads(back.payload) == {
        "source_key": "a.md", "error_type": "ValueError", "error_message": "Unsupported object key extension: a.md"}
    assert str(back.failed_date) == "2024-01-05"


def test_span_label_counts(spark):
    from docweave.operators import redaction
    df = spark.createDataFrame([([("EMAIL", 0, 3), ("EMAIL", 5, 8), ("CREDIT_DEBIT_NUMBER", 10, 20),
                                  ("ADDRESS", 30, 40), ("NAME", 1, 2)],)],
                               "s array<struct<type:string,begin:int,end:int>>")
    got = df.select(redaction.span_label_counts(F.col("s")).alias("m")).first().m
    assert got == {"EMAIL": 2, "CREDIT_CARD": 1}


def test_recommended_conf_bounds():
    from docweave.session import recommended_conf
    assert recommended_conf(10**9, 8)["spark.sql.shuffle.partitions"] == "16"
    assert recommended_conf(100 * 2**40, 8000)["spark.sql.shuffle.partitions"] == "160000"


def test_sparse_embedding_equals_dense_nonzeros(spark):
    df = spark.createDataFrame([("alpha beta beta gamma",), ("",), ("x y z x",)], "t string")
    rows = df.select(embedding.hash_embed(F.col("t"), 64).alias("d"),
                     embedding.hash_embed_sparse(F.col("t"), 64).alias("s")).collect()
    for r in rows:
        if r.d is None:            # empty text: no vector (struct with NULL arrays)
            assert r.s.buckets is None and r.s.weights is None
            continue
        nz = [(i, w) for i, w in enumerate(r.d) if w != 0]
        assert list(zip(r.s.buckets, r.s.weights)) == nz
        assert abs(sum(w * w for w in r.d) - 1) < 1e-9


def test_status_only_embedding_matches_vectors(spark):
    df = spark.createDataFrame([("alpha beta",), ("x",), ("",), ("a a",)], "t string")
    r = df.select(embedding.hash_embed(F.col("t"), 8).alias("v"),
                  embedding.hash_embed_status(F.col("t"), 8).alias("s")).collect()
    assert [x.s for x in r] == ["OK" if x.v is not None else "MISSING" for x in r]
