import random

import corpus_pipeline
import pytest

from docweave.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_chain_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    counts = [len(ids)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and kept, name
        ids = kept
        counts.append(len(kept))
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[0]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids_sha256 for i, r in rows.items()} == {r.doc_id: r.ids_sha256 for r in docs.collect()}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, make_docs, stage):
    assert stage(spark, make_docs([]), SF).count() == 0


def test_null_and_repeated_ids_drop_only_members_of_one_component(spark, make_docs):
    rng = random.Random(12)

    def text():
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(1500))

    def near(t):
        return t.replace(t.split()[700], "zzzzz", 1)

    first, alone, twice = text(), text(), text()
    rows = [(None, text()) for _ in range(20)]               # a source without ids
    rows += [(None, twice), (None, near(twice))]             # near copies without ids
    rows += [(1, first), (7, near(first)), (7, alone)]       # an id with two texts, one a near copy
    comp = {r.doc_id: r.component_id for r in simhash.near_dedup(
        make_docs([(1, first), (2, near(first)), (3, twice), (4, near(twice))])).collect()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 3}
    kept = simhash.keep_one(make_docs(rows))
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    ones = [t for _, t in got if t in (twice, near(twice))]
    assert len(ones) == 1
    want = [(0, t) for _, t in rows[:20]] + [(0, ones[0]), (1, first), (7, alone)]
    assert got == sorted(want)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")       # rates of one
    whole = mixing.mixed(make_docs(rows), labels)
    assert sorted((r.doc_id or 0, r.text) for r in whole.collect()) == sorted((i or 0, t) for i, t in rows)
