import tempfile

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from docweave.llm import token_order as to
from docweave.llm.byte_bpe import load_ranks

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097, 70001])
def test_permutation(n):
    for key in (1, 2):
        got = to.Feistel(n, key)(np.arange(n))
        assert sorted(got.tolist()) == list(range(n))
        parts = np.concatenate([to.Feistel(n, key)(np.arange(i, min(i + 13, n))) for i in range(0, n, 13)]) if n < 5000 else got
        assert (parts == got).all()
    if n >= 1000:
        a, b = to.Feistel(n, 1)(np.arange(n)), to.Feistel(n, 2)(np.arange(n))
        assert (a != b).mean() > 0.95 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.1


def test_records():
    got = to._records([7, None, -1], [[1, 2, 3, 4, 5], [9], [6, 7]], 2)
    want = [(7, 0, [1, 2]), (7, 1, [3, 4]), (7, 2, [5]), (-(1 << 63), 0, [9]), (-1, 0, [6, 7])]
    assert [bytes(r) for r in got] == [
        i.to_bytes(8, "big", signed=True) + k.to_bytes(4, "big") + len(ids).to_bytes(2, "big")
        + b"".join(x.to_bytes(2, "little") for x in ids + [0xFFFF] * (2 - len(ids))) for i, k, ids in want]
    assert to._binary(got).to_pylist() == [bytes(r) for r in got]


def test_shards_hold_every_sequence_once_at_its_slot(spark, make_docs):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(FILE), special_tokens={})
    rows = [(i, " ".join(f"word{j}" for j in range(i % 37))) for i in range(200)]
    rows += [(-5, "minus\nfive"), (None, "no id"), (300, None), (301, ""), (7, "again"), (7, "again"),
             (302, "long text " * 3000)]
    docs = make_docs(rows).withColumn("slot", F.lit(0)).repartition(3).checkpoint()
    path = tempfile.mkdtemp(prefix="docweave-test-") + "/shards"
    shards = to.write_shards(docs, path, FILE, P.PATTERN, seed=5, seq_len=16, rows_per_shard=10)
    out = to.read_slots(spark, shards).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(shards.n_sequences))
    assert all(r.shard == r.slot // 10 for r in out)
    want = sorted((str(i), k // 16, tuple(ids[k:k + 16])) for i, t in rows if t
                  for ids in [lib.encode_ordinary(t)] for k in range(0, len(ids), 16))
    got = [(str(r.doc_id), r.seq_no, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in out]
    assert sorted(got) == want and got != want
    part = to.read_slots(spark, shards, 13, 38).orderBy("slot").collect()
    assert part == out[13:38]
    raw = spark.read.format("binaryFile").load(path).where("shard = 2").first().content
    assert len(raw) == 10 * shards.stride and raw[shards.stride - 1:shards.stride] == b"\n"
    again = to.write_shards(docs, path + "2", FILE, P.PATTERN, seed=5, seq_len=16, rows_per_shard=10)
    assert to.read_slots(spark, again).orderBy("slot").collect() == out


def test_empty_tables(spark, make_docs):
    for rows in ([], [(1, None), (2, "")]):
        out = to.training_order(make_docs(rows), FILE, P.PATTERN)
        assert out.count() == 0 and out.columns[0] == "slot"


def test_few_range_partitions_give_the_same_shards(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "some words " * (i % 40)) for i in range(150)]).checkpoint()
    path = tempfile.mkdtemp(prefix="docweave-test-")
    many = to.write_shards(docs, path + "/many", FILE, P.PATTERN, seq_len=8, rows_per_shard=2)
    monkeypatch.setattr(to, "WAVES", 1)
    few = to.write_shards(docs, path + "/few", FILE, P.PATTERN, seq_len=8, rows_per_shard=2)
    assert many.n_sequences > 600
    a, b = (to.read_slots(spark, s).orderBy("slot").collect() for s in (many, few))
    assert a == b
