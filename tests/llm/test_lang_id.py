import random

import pytest
from pyspark.sql import functions as F

from docweave.llm import lang_id

SYLLABLES = {"en": ["the", "ing", "wh", "er"], "de": ["sch", "ein", "ung", "keit"],
             "fr": ["eau", "é", "oi", "que"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(30)]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(make_docs):
    rows = corpus(240)
    odd = [(1001, None), (1002, ""), (1003, "123 !! ²"), (1004, "x" * 50000), (None, "the ing")]
    docs = make_docs(rows + [o + (None,) for o in odd]).withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in lang_id.language_id(docs).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert [out[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3
    assert out[1004].lang_pred in SYLLABLES and out[None].held_out is False
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = lang_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, _, _ in rows}
    assert not {1001, 1002, 1003} & {r.doc_id for r in kept.collect()}


def test_held_out_rows_and_other_columns_do_not_matter(make_docs):
    import zlib
    rows = corpus(90)
    base = lang_id.fit(make_docs(rows))
    changed = [(i, "zzz qqq", "xx") if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t, lang)
               for i, t, lang in rows]
    again = lang_id.fit(make_docs(changed))
    assert base["langs"] == again["langs"] and set(base["words"]) == set(again["words"])


def test_back_off_order():
    import numpy as np
    model = lang_id.pack(["a", "b"], {"abc": np.array([0.0, -1.0])}, {
        4: {"^abd": np.array([-9.0, 0.0])}, 1: {"d": np.array([0.0, -9.0])}})
    for memo in (0, 1, 100):            # a full memory changes nothing
        s = lang_id.Scorer(model, memo)
        assert s.predict("abc")[0] == "a" and s.predict("abd")[0] == "b" and s.predict("d")[0] == "a"
        assert s.predict("abd abd d x1") == s.predict("d x1 abd abd")
    s = lang_id.Scorer(model)
    assert s.predict("abc")[0] == "a" and s.predict("abd")[0] == "b" and s.predict("d")[0] == "a"
    assert s.predict("q") == ("a", 0.5) and s.predict("1")[0] == "und"


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "abc", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in lang_id.language_id(docs).collect()} == {("und", 0.0)}
    assert lang_id.language_id(make_docs([])).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(30000).withColumnRenamed("id", "doc_id")
    assert lang_id.bounded_sample(rows, "doc_id", 40000).count() == 30000
    assert lang_id.bounded_sample(rows, "doc_id", 3000).count() == pytest.approx(3000, rel=0.15)


def test_rows_without_ids_are_sampled_row_by_row(make_docs):
    from docweave.llm.common import sampled
    docs = make_docs([(None, f"wort {i % 9} und", "de") for i in range(25_000)])
    for seed in range(4):
        assert abs(sampled(docs, 3000, seed).count() - 3000) < 450
    out = lang_id.language_id(docs, fit_rows=3000)
    assert out.where("lang_pred = 'und'").count() == 0 and out.count() == 25_000


def test_many_languages_share_the_model(make_docs, monkeypatch):
    monkeypatch.setattr(lang_id, "MODEL_CELLS", 5_000)
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i % 80 // 26)}x " * 5, f"l{i % 80:02d}") for i in range(800)]
    model = lang_id.fit(make_docs(rows))
    assert len(model["langs"]) == 80 and model["matrix"].size <= 5 * 5_000
    out = lang_id.language_id(make_docs(rows))
    assert out.where("lang_pred = 'und'").count() == 0
