"""Names by automaton, overlapping detector windows."""

import random
import re

import pytest
from docweave.operators import names as nm
from docweave.operators import redaction, segmentation
from pyspark.sql import functions as F


def brute(text, names):
    spans = []
    for n in set(names):
        for b in range(len(text) - len(n) + 1):
            if (text.startswith(n, b) and not (b and text[b - 1].isalnum())
                    and not (b + len(n) < len(text) and text[b + len(n)].isalnum())):
                spans.append((b, b + len(n)))
    kept, end = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


@pytest.mark.parametrize("max_chars", [nm.MAX_CHARS, 40])
def test_names_of_any_length_against_brute_force(spark, max_chars):
    rng = random.Random(2)
    words = ["Ann", "Lee", "van", "der", "Ü", "a", "Bo2", "Annabel"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)] + ["", "O'Hara"]
    texts = [None, "", "O'Hara, Ann", "xAnn Ann2 (Ann)"] + [
        rng.choice(["", "-"]).join(rng.choices(words + [" ", ", ", "\n"], k=30)) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=40)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for r in df.select("id", "t", nm.name_spans(F.col("t"), table, max_chars=max_chars).alias("s")).collect():
        if r.t is None:
            assert r.s is None
        else:
            assert [(x.begin, x.end) for x in r.s] == brute(r.t, [n for n in names if n]), r.t
            assert {x.type for x in r.s} <= {"NAME"}


def test_long_list_and_redaction(spark):
    table = spark.createDataFrame([(f"Name{i} Of House {i}",) for i in range(5000)], "name string")
    df = spark.createDataFrame([("With Name77 Of House 77 and Name4999 Of House 4999.",)], "t string")
    out = df.select(redaction.splice_spans(F.col("t"), nm.name_spans(F.col("t"), table)).alias("o")).first().o
    assert out == "With [REDACTED_NAME] and [REDACTED_NAME]."
    none = spark.createDataFrame([], "name string")
    assert df.select(nm.name_spans(F.col("t"), none).alias("s")).first().s == []


def test_windows_find_every_entity_at_every_cut_position():
    detect = segmentation.regex_detector()
    for shift in range(0, 130):
        text = "é" * shift + " 4111-1111-1111-1111 x a.b@c.io, +1 (743) 555-3824 yé" + "z" * 40 + " 123-45-6789 end" * 3
        out = []
        for begin, end, at, window in segmentation.windows(text, 256, 96):
            assert len(window.encode()) <= 256
            out += [(s["type"], s["begin"] + at, s["end"] + at) for s in detect(window)
                    if begin <= s["begin"] + at < end]
        assert sorted(out) == sorted((s["type"], s["begin"], s["end"]) for s in detect(text)), shift


def test_windows_answer_for_every_code_point_once():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("aé €𝄞\n", k=rng.randint(0, 300)))
        found = segmentation.windows(text, rng.choice([16, 33, 64]))
        assert [b for b, _, _, _ in found][:1] == [0] and found[-1][1] == len(text)
        assert all(x[1] == y[0] for x, y in zip(found, found[1:]))
        assert all(text.startswith(w, at) for _, _, at, w in found)
    with pytest.raises(ValueError):
        segmentation.windows("a" * 99, 8, 4)


def test_detect_spans_with_windows_in_spark(spark):
    text = ("long words " * 9 + "joe@example.org ") * 40
    df = spark.createDataFrame([(text,), (None,)], "t string")
    r = df.select(segmentation.detect_spans(F.col("t"), max_bytes=200).alias("s")).collect()
    assert [(x.begin, x.end) for x in r[0].s] == [m.span() for m in re.finditer("joe@example.org", text)]
    assert r[1].s is None


def test_detector_finds_what_the_patterns_find():
    from docweave.functions import pii
    rng, detect, n = random.Random(5), segmentation.regex_detector(), 0
    parts = ["@x.co", "a.b@c.de", "@", "1x", ".", "-", "555-123-4567", "(212) ", "+1 ", "1234", "123-45-6789",
             "4111 1111 1111 1111", "é", " ", "\n", "ab", "_", "\u0661\u0662\u0663\u0664"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        found = [(segmentation._LABEL_TO_TYPE[label], *m.span()) for label, p in pii.PII_PATTERNS
                 for m in re.finditer(p, text)]
        assert [(s["type"], s["begin"], s["end"]) for s in detect(text)] == found, text
        n += len(found)
    assert n > 5000


def test_long_words_and_a_drawn_list_of_names_cost_in_proportion(spark, tmpdir_path):
    import time

    from docweave.plans import q_ops
    long_word = "a" * 300_000 + "@"                     # tried from each letter it takes minutes
    rows = [(1, long_word), (2, "to ann.12@x.io by ann, bob.1@"), (3, None), (4, "bob ann4@x.io")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    began = time.time()
    out = {r.doc_id: r for r in q_ops.pii_redact_spans(spark, tmpdir_path).collect()}
    assert time.time() - began < 40
    assert out[1].redacted_text == long_word and out[3].redacted_text is None
    assert out[2].redacted_text == "to [REDACTED_EMAIL] by [REDACTED_NAME], [REDACTED_NAME].1@"
    assert (out[2].spans_found, out[2].spans_kept) == (4, 3)
    assert out[4].redacted_text == "[REDACTED_NAME] [REDACTED_EMAIL]"

    read = f"{tmpdir_path}/read"

    def drawn(batches):
        for b in batches:
            with open(read, "a") as f:
                f.writelines("x\n" for _ in range(len(b)))
            yield b

    names = spark.createDataFrame([(f"n{i}",) for i in range(20)], "name string").mapInPandas(drawn, "name string")
    assert sorted(sum(nm._parts(names, "name", 20), [])) == sorted(f"n{i}" for i in range(20))
    assert len(open(read).readlines()) == 20            # the list's rows were made once
