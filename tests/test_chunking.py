"""Chunker (T2) and tokenizer (T1): the reference's own cases plus edges and properties."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docweave.operators import chunking


def chunks_of(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = chunking.chunk_documents(df, "text", size, overlap, keep=["id"]).orderBy("chunk_id").collect()
    return [(r.chunk_id, r.start_token, r.end_token, r.token_count, r.text_chunk) for r in rows]


def test_twenty_words_size_ten_overlap_two(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = chunks_of(spark, text, 10, 2)
    assert [(c[1], c[2]) for c in got] == [(0, 10), (8, 18), (16, 20)]
    assert got[0][3] == 10 and got[0][4].startswith("w0 ")
    assert got[1][4].startswith("w8 ")


def test_blank_text_has_no_chunks(spark):
    assert chunks_of(spark, "   ", 500, 50) == []


SPANS_10_2 = {1: [(0, 1)], 10: [(0, 10)], 11: [(0, 10), (8, 11)], 18: [(0, 10), (8, 18)],
              19: [(0, 10), (8, 18), (16, 19)], 27: [(0, 10), (8, 18), (16, 26), (24, 27)],
              28: [(0, 10), (8, 18), (16, 26), (24, 28)]}


@pytest.mark.parametrize("n", sorted(SPANS_10_2))
def test_boundary_spans(spark, n):
    got = chunks_of(spark, " ".join(f"t{i}" for i in range(n)), 10, 2)
    assert [(c[1], c[2]) for c in got] == SPANS_10_2[n]
    assert [c[0] for c in got] == list(range(len(got)))
    assert all(c[4] == " ".join(f"t{i}" for i in range(c[1], c[2])) for c in got)


def test_zero_overlap(spark):
    got = chunks_of(spark, " ".join(str(i) for i in range(25)), 10, 0)
    assert [(c[1], c[2], c[3]) for c in got] == [(0, 10, 10), (10, 20, 10), (20, 25, 5)]


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 12), (10, -1), (0, 0)])
def test_invalid_parameters_rejected(size, overlap):
    with pytest.raises(ValueError):
        chunking.validate_chunk_params(size, overlap)


def test_python_whitespace_is_a_separator(spark):
    seps = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85",
            "\xa0", "\u1680", "\u2000", "\u2005", "\u200a", "\u2028", "\u2029", "\u202f",
            "\u205f", "\u3000"]
    text = "a" + "b".join(seps) + "c"
    got = chunks_of(spark, text, 500, 50)
    assert got[0][4].split(" ") == text.split()


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 60), size=st.integers(1, 12), overlap=st.integers(0, 11))
def test_property_full_cover_and_fixed_overlap(spark, n, size, overlap):
    if overlap >= size:
        return
    text = " ".join(f"x{i}" for i in range(n))
    got = chunks_of(spark, text, size, overlap)
    assert all(c[3] == c[2] - c[1] for c in got) and (not got or got[-1][2] == n)
    assert all(c[3] == size and d[1] == c[2] - overlap for c, d in zip(got, got[1:]))
    rebuilt = []
    for cid, start, end, cnt, t in got:
        toks = t.split(" ")
        rebuilt += toks[(len(rebuilt) - start):]
    assert rebuilt == text.split()


def test_nested_chunk_array_equals_exploded_rows(spark):
    text = " ".join(f"w{i}" for i in range(23))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    tok = df.select("id", F.split("text", " ").alias("toks"))
    arr = tok.select(chunking.chunk_struct_array("toks", 10, 8).alias("c")).first().c
    assert [(c.chunk_id, c.start_token, c.end_token, c.text_chunk) for c in arr] == \
        [(i, a, b, " ".join(f"w{k}" for k in range(a, b))) for i, (a, b) in enumerate([(0, 10), (8, 18), (16, 23)])]
