"""Source parsers: event shapes (S2), request envelopes (S4), samples (S6), responses."""

import base64
import json

from docweave.operators import rag
from docweave.sources import events as ev


def test_event_shapes(spark):
    recs = [
        (1, json.dumps({"bucket": "b", "key": "uploads/a+b%20c.txt"})),
        (2, json.dumps({"detail": {"bucket": {"bucketName": "b2"}, "object": {"key": "k2.pdf"}}})),
        (3, json.dumps({"Records": [{"s3": {"bucket": {"name": "b3"}, "object": {"key": "x%2Fy.txt"}}}]})),
        (4, json.dumps({"bucket": "", "key": "k", "detail": {"bucket": {"name": "b4"}, "object": {"key": "k4"}}})),
        (5, json.dumps({"something": 1})),
        (6, "{not json"),
    ]
    df = spark.createDataFrame(recs, "id long, event_json string")
    got = {r.id: (r.bucket, r.key, r.resolve_status) for r in ev.resolve_event_location(df).collect()}
    assert got[1] == ("b", "uploads/a b c.txt", "RESOLVED")
    assert got[2] == ("b2", "k2.pdf", "RESOLVED")
    assert got[3] == ("b3", "x/y.txt", "RESOLVED")
    assert got[4] == ("b4", "k4", "RESOLVED")
    assert got[5][2] == "FAILED" and got[6][2] == "FAILED"


def test_request_bodies(spark):
    b64 = base64.b64encode(json.dumps({"question": " hi "}).encode()).decode()
    rows = [(1, json.dumps({"question": "What?"}), False), (2, b64, True), (3, json.dumps({"question": 5}), False),
            (4, json.dumps({"question": None}), False), (5, json.dumps({}), False), (6, "", False),
            (7, json.dumps([1, 2]), False), (8, "{bad", False), (9, json.dumps({"question": "   "}), False)]
    df = spark.createDataFrame(rows, "request_id long, body string, is_base64 boolean")
    got = {r.request_id: (r.status_code, r.question) for r in ev.parse_question_requests(df).collect()}
    assert got[1] == (200, "What?") and got[2] == (200, "hi") and got[3] == (200, "5")
    assert got[4][0] == 400 and got[5][0] == 400 and got[6][0] == 400 and got[9][0] == 400
    assert got[7][0] == 500 and got[8][0] == 500


def test_bench_samples(spark):
    ok = json.dumps({"answer": "x" * 200, "latency_ms": {"total": 0, "embedding": 1.5, "llm": "n/a"},
                     "usage": {"input_tokens": 7}})
    rows = [(1, 200, ok, 99.0), (2, 500, "e" * 300, 12.0), (3, 200, json.dumps({"error": "x"}), 5.0)]
    df = spark.createDataFrame(rows, "id long, http_status int, body string, wall_ms double")
    got = {r.id: r for r in ev.parse_bench_samples(df).collect()}
    assert got[1].ok and got[1].total_ms == 99.0 and got[1].embedding_ms == 1.5 and got[1].llm_ms is None
    assert got[1].input_tokens == 7 and got[1].output_tokens == 0 and len(got[1].answer_preview) == 120
    assert not got[2].ok and len(got[2].error) == 200
    assert not got[3].ok


def test_model_responses(spark):
    rows = [(1, json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b "}],
                             "usage": {"input_tokens": 3, "output_tokens": 2}})),
            (2, json.dumps({"content": [{"type": "tool_use"}, {"type": "text", "text": ""}]})),
            (3, json.dumps({"content": [{"type": "text", "text": "I do not have access to that information."}]}))]
    df = spark.createDataFrame(rows, "id long, response_json string")
    got = {r.id: r for r in rag.parse_model_response(df).collect()}
    assert got[1].answer == "a\nb" and got[1].status_code == 200 and got[1].input_tokens == 3
    assert got[2].answer is None and got[2].status_code == 500 and got[2].output_tokens == 0
    from pyspark.sql import functions as F
    assert rag.parse_model_response(df).where(rag.is_refusal(F.col("answer"))).count() == 1


def test_response_flattening_strips_all_whitespace(spark):
    body = json.dumps({"content": [{"type": "text", "text": "\n I do not have access to that information.　"}]})
    df = spark.createDataFrame([(1, body)], "id long, response_json string")
    r = rag.parse_model_response(df).first()
    assert r.answer == "I do not have access to that information."
    from pyspark.sql import functions as F
    assert rag.parse_model_response(df).where(rag.is_refusal(F.col("answer"))).count() == 1
