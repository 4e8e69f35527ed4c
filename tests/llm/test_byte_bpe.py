import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docweave.llm import byte_bpe

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.load_ranks(FILE)
    return byte_bpe.TreeBpe(ranks, P.PATTERN, memo=200), tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(both):
    bpe, lib = both
    rng = random.Random(1)
    parts = ["a", "b", "the", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "中",
             "文", "😀", "1", "²", "½", "'s", "'", "!", "$", "_", "ing", "er", "\r\n", "ٱ", "́",
             "ABC", "zzzz", "aaaaaaa", "<|endoftext|>", ".", ","]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t), repr(t)
        assert bpe.decode(ids) == t.encode()


def test_a_word_is_remembered_once_and_memory_is_bounded(both):
    ranks = byte_bpe.load_ranks(FILE)
    bpe, lib = byte_bpe.TreeBpe(ranks, P.PATTERN), both[1]
    words = ["".join(random.Random(i).choices("bcdfghjklmnpqrstvwxz", k=12)) for i in range(50)]
    text = "x " + " ".join(words)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == lib.encode_ordinary(text)
    assert set(words) <= set(bpe.words)
    assert not {f" {w}".encode() for w in words} & set(bpe.halves)      # only their halves
    small = byte_bpe.TreeBpe(ranks, P.PATTERN, memo=20)
    assert small.encode(text) == bpe.encode(text)
    assert max(len(small.words), len(small.halves), len(small.pairs)) <= 20
    assert byte_bpe.MEMO_ENTRIES <= 300_000             # three dictionaries, four workers an executor


@pytest.mark.parametrize("n", [5, 49, 300, 3000])
def test_long_pieces_need_the_tree(both, n):
    bpe, lib = both
    rng = random.Random(n)
    for t in ("a" * n, "ab" * n, "=-" * n, "".join(rng.choices("etaoinshr", k=n)), "é" * n):
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_query_form(make_docs, both):
    _, lib = both
    rows = [(1, "Hello world, hello."), (2, None), (3, ""), (None, "x"), (1, "Hello world, hello.")]
    docs = make_docs(rows).withColumnRenamed("source", "ids")
    for r in byte_bpe.round_trip(docs, FILE, P.PATTERN).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = np.array(lib.encode_ordinary(t), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    enc = byte_bpe.encode_documents(docs, FILE, P.PATTERN)
    back = byte_bpe.decode_documents(enc, FILE, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.round_trip(make_docs([]), FILE, P.PATTERN).count() == 0
