"""Property tests: redaction equals sequential Python replacement; distributed exact
percentiles equal numpy's linear interpolation on random groups."""

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from docweave.functions import pii as P
from docweave.operators import metrics as M
from docweave.operators import redaction

PIECES = st.sampled_from(["4111 1111 1111 1111", "123-45-6789", "+1 (555) 123-4567", "555.123.4567",
                          "a@b.io", "x.y@mail.example.com", "12345", "-", " ", "\n", "word", "@", ".",
                          "9999", "(555)", "1"])


def sequential(text):
    for label, pat in P.PII_PATTERNS:
        text = re.sub(pat, f"[REDACTED_{label}]", text)
    return text


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=8))
def test_redaction_matches_sequential_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.redacted_text for r in redaction.redact_documents(df).collect()}
    assert got == {i: sequential(t) for i, t in enumerate(texts)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=300))
def test_percentiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double").repartition(5)
    got = {r.g: r for r in M.exact_percentiles(df, ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        vals = np.array([v for gg, v in rows if gg == g])
        for name, p in M.PCTS.items():
            assert abs(getattr(got[g], name) - np.percentile(vals, p * 100)) <= 1e-6 * max(1.0, abs(vals).max())


SPAN_TYPES = ["EMAIL", "NAME", "SSN", "PHONE", "CREDIT_DEBIT_NUMBER", "ADDRESS"]
LABELS = {"SSN": "SSN", "EMAIL": "EMAIL", "NAME": "NAME", "PHONE": "PHONE", "CREDIT_DEBIT_NUMBER": "CREDIT_CARD"}


def splice_py(text, spans):
    acc = [s for s in spans if s[0] in LABELS]
    acc.sort(key=lambda s: (s[1], -s[2], s[0]))
    kept = []
    for s in acc:
        if not kept or s[1] >= kept[-1][2]:
            kept.append(s)
    for t, b, e in reversed(kept):
        text = f"{text[:b]}[REDACTED_{LABELS[t]}]{text[e:]}"
    return text


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abcé中 ", min_size=1, max_size=40).flatmap(
    lambda t: st.tuples(st.just(t), st.lists(st.tuples(st.sampled_from(SPAN_TYPES),
                                                       st.integers(0, len(t) - 1), st.integers(1, 8)),
                                             max_size=6))))
def test_span_splice_matches_python(spark, case):
    from pyspark.sql import functions as F
    text, raw = case
    spans = [(t, b, min(len(text), b + n)) for t, b, n in raw]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<type:string,begin:int,end:int>>")
    got = df.select(redaction.splice_spans(F.col("t"), F.col("s")).alias("o")).first().o
    assert got == splice_py(text, spans)
