"""Edge cases for operators otherwise covered by oracle queries only."""

from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T
from docweave.operators import deadletters, ingest, metrics, redaction, routing


def test_vectorize_gate(spark):
    m = spark.createDataFrame([("a", "SUCCESS", 2), ("b", "SUCCESS", 0), ("c", "FAILED", None), ("d", None, None)],
                              "source_key string, status string, chunk_count int")
    got = {r.source_key: (r.gate, r.gate_error) for r in routing.vectorize_gate(m).collect()}
    assert got["a"] == ("VECTORIZE", None)
    assert got["b"] == ("DLQ", "No chunks found in processed payload")
    assert got["c"][0] == "DLQ" and got["d"] == ("DLQ", "Expected SUCCESS payload, got status=None")


def test_object_key_and_content_type(spark):
    df = spark.createDataFrame([(7, "My File.PDF", "")], "id long, name string, ct string")
    r = df.select(T.object_key(T.sanitize_filename("name"), F.to_timestamp(F.lit("2024-03-04 05:06:07")), "id").alias("k"),
                  T.default_content_type("ct", T.filename_extension("name")).alias("t")).first()
    assert r.k.startswith("uploads/20240304T050607Z-") and r.k.endswith("-My_File.pdf")
    assert len(r.k.split("-")[1]) == 8 and r.t == "application/pdf"


def test_round_robin_questions(spark):
    got = [r.question for r in metrics.round_robin(spark.range(12), "id").orderBy("id").collect()]
    assert got[:10] == C.DEFAULT_QUESTIONS and got[10:] == C.DEFAULT_QUESTIONS[:2]


def test_new_objects_by_key_and_time(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source_key string, t int")
    manifest = spark.createDataFrame([("a", 1), ("b", 1)], "source_key string, t int")
    assert sorted(r.source_key for r in ingest.new_objects(listing, manifest).collect()) == ["c"]
    assert sorted(r.source_key for r in ingest.new_objects(listing, manifest, time_col="t").collect()) == ["b", "c"]


def test_rollup_has_subtotals_and_grand_total(spark):
    df = spark.createDataFrame([("s1", "en", "x@y.com"), ("s1", "fr", "none"), ("s2", "en", "4111 1111 1111 1111")],
                               "source string, lang string, text string")
    r = {(x.source, x.lang): x for x in redaction.pii_rollup(redaction.redact_documents(df), ["source", "lang"]).collect()}
    assert r[(None, None)].docs == 3 and r[(None, None)].masked_docs == 2
    assert r[("s1", None)].sum_email == 1 and r[("s2", "en")].sum_credit_card == 1


def test_slo_report_met_and_missed(spark):
    s = spark.createDataFrame([("total", 1500.0, 3500.0, 3999.0)], "stage string, p50_ms double, p90_ms double, p99_ms double")
    got = {r.percentile: r.result for r in metrics.slo_report(s).collect()}
    assert got == {"p50": "Met", "p90": "Missed", "p99": "Met"}


def test_failure_sample_first_five_by_id(spark):
    rows = [(i, i % 2 == 0, 500, "e" * 300) for i in range(20, 0, -1)]
    df = spark.createDataFrame(rows, "request_id long, ok boolean, status int, error string")
    got = metrics.failure_sample(df, "request_id").collect()
    assert [r.request_id for r in got] == [1, 3, 5, 7, 9] and all(len(r.error) == 160 for r in got)


def test_retention_keeps_last_fourteen_days(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-17 00:00:01"), (3, "2024-01-31 00:00:00"),
                                (4, "2024-01-17 00:00:00")],
                               "id int, t string").select("id", F.to_timestamp("t").alias("failed_at"))
    # strictly newer than latest - 14 days: a record exactly 14 days old has expired
    assert sorted(r.id for r in deadletters.retain(df).collect()) == [2, 3]


def test_sliding_rate_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:00",), ("2024-01-01 02:30:00",)], "ts string") \
        .select(F.to_timestamp("ts").alias("ts"))
    got = {str(r.window_start): r.requests for r in metrics.rate_windows(df, "ts", "3 hours", "1 hour", 2).collect()}
    assert got["2024-01-01 00:00:00"] == 3 and got["2023-12-31 22:00:00"] == 2


def test_blank_chunks_are_not_embedded(spark):
    chunks = spark.createDataFrame([("k1", "alpha beta", 2), ("k2", "", 0)],
                                   "chunk_key string, text_chunk string, token_count int")
    got = {r.chunk_key: r.embed_status for r in ingest.embed_chunks(chunks, 16).collect()}
    assert got == {"k1": "OK"}


def test_prompt_text_and_request(spark):
    import json

    from docweave.operators import rag
    df = spark.createDataFrame([("ctx here", "why?")], "context string, question string")
    r = rag.build_prompt(df).first()
    assert r.system_prompt == C.SYSTEM_PROMPT_PREFIX + "ctx here"
    req = json.loads(r.request_json)
    assert req["max_tokens"] == 1024 and req["temperature"] == 0.2
    assert req["messages"] == [{"role": "user", "content": [{"type": "text", "text": "why?"}]}]


def test_language_filter_reaches_the_scan(spark):
    from docweave.sources.tables import source_documents
    df = source_documents(spark, "/root/testdata/sf0.001", F.col("lang") == "en")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_context_block_numbering_fallback_and_no_hits(spark):
    from docweave.operators import rag
    qs = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 2, 0.5, "", 3, False, "second"), (1, 1, 0.9, "doc-a", 0, True, "first")],
                                 "query_id long, rank int, score double, source_document string, chunk_id int, "
                                 "pii_masked_flag boolean, text_chunk string")
    got = {r.query_id: r for r in rag.format_context(qs, hits).collect()}
    assert got[1].context == "[1] (source: doc-a)\nfirst\n\n[2] (source: unknown)\nsecond"
    assert got[1].retrieved_count == 2 and got[1].sources[0].source_document == "doc-a"
    assert got[2].context == C.NO_CONTEXT_TEXT and got[2].retrieved_count == 0


def test_citation_counts(spark):
    from docweave.operators import rag
    hits = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "query_id long, source_document string")
    got = {r.source_document: (r.citations, r.questions) for r in rag.citation_counts(hits).collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}
