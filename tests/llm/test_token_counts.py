import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docweave.llm import token_counts as tc

FILE = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return tc.load_pieces(FILE)


def brute(word, pieces, outside):
    """Best (score, pieces) over all segmentations, without a trie."""
    text = tc.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = []
        for i in range(end):
            p = text[i:end]
            if p in pieces:
                options.append((best[i][0] + pieces[p], best[i][1] - 1))
            elif len(p) == 1:
                n = len(p.encode())
                options.append((best[i][0] + n * outside, best[i][1] - n))
        best.append(max(options))
    return -best[-1][1]


def test_against_brute_force_and_the_library(pieces):
    from tokenizers import models
    rng = random.Random(1)
    words = ["", "the", "internationalisation", "中文字", "😀x", "naïve", "Ünïcödé", "zzzzzz"]
    words += ["".join(rng.choices("etaoinshrdluéüß中😀", k=rng.randint(1, 14))) for _ in range(300)]
    for nodes in (10, 1_000_000):
        trie = tc.PieceTrie(pieces, max_nodes=nodes, max_words=50)
        for at in range(0, len(words), 20):
            some = {w.encode() for w in words[at:at + 20]}
            rest = trie.learn(some)
            for w in some:
                got = rest[w] if w in rest else trie.words[w]
                assert got == brute(w.decode(), pieces, trie.outside), w
    lib = models.Unigram([("<unk>", -99.0), *pieces.items()], 0, False)
    for w in ("▁the", "▁international", "▁statement", "▁working"):
        assert len(lib.tokenize(w)) == tc.PieceTrie(pieces).alone(w)


def test_shared_prefixes_make_nodes_once(pieces):
    trie = tc.PieceTrie(pieces)
    trie.learn({b"working", b"worker", b"work"})
    assert len(trie.score) == 1 + len("▁working") + len("er")


def test_query_form(make_docs, pieces):
    long = "x" * 3000
    rows = [(1, "the cat\tsat\x0b on"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long),
            (None, "a\x85b c\xa0d"), (6, "w " * 30000)]
    trie = tc.PieceTrie(pieces)
    docs = make_docs(rows).withColumn("n_tokens", F.lit(9))
    out = tc.count_tokens(docs, FILE).collect()
    assert len(out) == len(rows)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        assert r.n_words == len(words)
        assert r.n_tokens == sum(trie.alone(tc.MARK + w) for w in words)
    assert tc.count_tokens(make_docs([]), FILE).count() == 0
