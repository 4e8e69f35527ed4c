"""Pattern redaction (P8), span splicing (P9), gazetteer (J6), counts (A1/A2)."""

import re

from pyspark.sql import functions as F

from docweave.functions import pii as P
from docweave.operators import redaction, segmentation


def redact_py(text):
    counts = {}
    for label, pat in P.PII_PATTERNS:
        n = len(re.findall(pat, text))
        if n:
            counts[label] = n
        text = re.sub(pat, f"[REDACTED_{label}]", text)
    return text, counts


LITERALS = [
    "SSN 123-45-6789 here",
    "mail a.b+c@example.co.uk now",
    "call +1 (743) 555-3824 today",
    "card 4111 1111 1111 1111 ok",
    "two mails x@y.org and z@w.net",
    "phone broken 555\n123\n4567 across lines",
    "run 12345678901234567890 of digits",
    "nothing to see here",
    "ssn spaced 123 - 45 - 6789",
]


def test_pattern_redaction_matches_sequential_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LITERALS)], "doc_id long, text string")
    out = redaction.redact_documents(df).orderBy("doc_id").collect()
    for row, text in zip(out, LITERALS):
        exp_text, exp_counts = redact_py(text)
        assert row.redacted_text == exp_text
        assert dict(row.pii_entity_counts) == exp_counts
        assert row.pii_masked_flag == bool(exp_counts)


def test_twenty_digit_run_card_first(spark):
    df = spark.createDataFrame([(1, "12345678901234567890")], "doc_id long, text string")
    assert redaction.redact_documents(df).first().redacted_text == "[REDACTED_CREDIT_CARD]7890"


def test_redaction_is_idempotent(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LITERALS)], "doc_id long, text string")
    once = redaction.redact_documents(df).select("doc_id", F.col("redacted_text").alias("text"))
    twice = redaction.redact_documents(once)
    assert twice.where("pii_masked_flag").count() == 0


SPANS = "array<struct<type:string,begin:int,end:int>>"


def splice(spark, text, spans):
    df = spark.createDataFrame([(text, spans)], f"t string, s {SPANS}")
    return df.select(redaction.splice_spans(F.col("t"), F.col("s")).alias("o")).first().o


def test_span_splice_disjoint_and_multibyte(spark):
    text = "é Bob bob@x.io"
    assert splice(spark, text, [("NAME", 2, 5), ("EMAIL", 6, 14)]) == "é [REDACTED_NAME] [REDACTED_EMAIL]"


def test_span_overlaps_resolved_without_debris(spark):
    text = "abcdefghij"
    got = splice(spark, text, [("NAME", 0, 5), ("EMAIL", 3, 8), ("SSN", 0, 2), ("ADDRESS", 8, 10)])
    # longest at the same begin wins; the crossing span is dropped; unknown type ignored
    assert got == "[REDACTED_NAME]fghij"
    got = splice(spark, text, [("CREDIT_DEBIT_NUMBER", 1, 3)])
    assert got == "a[REDACTED_CREDIT_CARD]defghij"


def test_regex_detector_spans_equal_pattern_redaction(spark):
    text = "mail a@b.com and c@d.org"
    df = spark.createDataFrame([(text,)], "t string")
    spans = segmentation.detect_spans(F.col("t"), segmentation.regex_detector(["EMAIL"]))
    got = df.select(redaction.splice_spans(F.col("t"), spans).alias("o")).first().o
    assert got == re.sub(dict(P.PII_PATTERNS)["EMAIL"], "[REDACTED_EMAIL]", text)


def test_gazetteer_unigrams_and_bigrams(spark):
    df = spark.createDataFrame([(1, "Met John Smith, then Alice."), (2, "no names")], "doc_id long, text string")
    names = spark.createDataFrame([("Alice",), ("John Smith",), ("Smith",)], "name string")
    hits = redaction.gazetteer_spans(df, names).orderBy("token_index", "name").collect()
    assert [(h.doc_id, h.name) for h in hits] == [(1, "John Smith"), (1, "Smith"), (1, "Alice")]


def test_detector_on_byte_segments_returns_text_offsets(spark):
    text = ("é" * 30 + " mail a@b.io ") * 6
    df = spark.createDataFrame([(text,)], "t string")
    whole = segmentation.detect_spans(F.col("t"), segmentation.regex_detector(["EMAIL"]))
    seg = segmentation.detect_spans(F.col("t"), segmentation.regex_detector(["EMAIL"]), max_bytes=64)
    row = df.select(whole.alias("a"), seg.alias("b")).first()
    assert [tuple(s) for s in row.a] == [tuple(s) for s in row.b]
    assert all(text[s.begin:s.end] == "a@b.io" for s in row.b)


def test_names_and_detector_spans_are_masked_before_chunking(spark):
    from docweave.operators import ingest
    df = spark.createDataFrame([("b", "a.txt", "Ann Lee met Ann, not Anne. a@b.com"), ("b", "c.txt", "nobody")],
                               "bucket string, source_key string, text string")
    out = {r.source_key: r for r in ingest.process_objects(df, names=["Ann", "Ann Lee"]).collect()}
    assert " ".join(out["a.txt"]["_tokens"]) == "[REDACTED_NAME] met [REDACTED_NAME], not Anne. [REDACTED_EMAIL]"
    assert out["a.txt"].pii_entity_counts == {"NAME": 2, "EMAIL": 1}
    assert out["c.txt"].pii_entity_counts == {} and out["c.txt"].pii_masked_flag is False
    span = F.array(F.struct(F.lit("NAME").alias("type"), F.lit(0).alias("begin"), F.lit(3).alias("end")))
    one = ingest.process_objects(df.where("source_key = 'a.txt'"), detector=lambda t: span).first()
    assert one["_tokens"][0] == "[REDACTED_NAME]" and one.pii_entity_counts == {"NAME": 1, "EMAIL": 1}


def test_both_knn_paths_treat_widths_alike(spark):
    import pytest
    from docweave.operators import retrieval
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_vector array<double>")
    ix = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", None)],
                               "chunk_key string, vector array<double>")
    got = [sorted(map(tuple, retrieval.knn_search(q, ix, 2, method=m, bad_width="skip").collect()))
           for m in ("broadcast", "tiled")]
    assert got[0] == got[1] and len(got[0]) == 4
    for m in ("broadcast", "tiled"):
        with pytest.raises(Exception, match="not of width 2"):
            retrieval.knn_search(q, ix, 2, method=m).collect()
    good, bad = retrieval.split_by_width(ix, 2)
    assert good.count() == 2 and {r.error_message for r in bad.collect()} == {
        "missing vector", "unexpected vector width 1"}


def test_sources_attach_alike_with_and_without_broadcast(spark):
    from docweave.operators import rag
    hits = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "gone", 0.4)],
                                 "query_id long, rank int, chunk_key string, score double")
    ix = spark.createDataFrame([("a", "s", 0, False, "t")], "chunk_key string, source_document string, "
                               "chunk_id int, pii_masked_flag boolean, text_chunk string")
    got = [sorted(map(str, rag.attach_sources(hits, ix, broadcast_hits=b).collect())) for b in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 2
