import random
import re

from docweave.llm.quality_rules import SYMBOLS, THRESHOLDS, measure, quality
from pyspark.sql import functions as F


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in tri:
        seen[x] = seen.get(x, 0) + 1
    cover = {i + d for i, x in enumerate(tri) if seen[x] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "é ß\x85z\n\né ß\x85z",
         "the cat # * |\nthe cat # * |\n\n  ", "a b c d a b c e b c d"]


def test_base_counts_against_brute_force(make_docs):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 80))) for _ in range(60)]
    texts.append("the long of it " * 5000 + "\n".join(str(i) for i in range(3000)))
    out = {r.doc_id: r for r in quality(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)


def test_thresholds_decide(make_docs):
    clean = " ".join(f"the w{i} of" for i in range(40)) + "."
    noisy = " ".join(f"the# w{i}$$ of%" for i in range(40))
    loud = " ".join(f"THE W{i}A OF" for i in range(40))
    out = {r.doc_id: r.kept for r in quality(make_docs(
        [(1, clean), (2, noisy), (3, loud), (3, loud), (None, clean)])).collect()}
    assert out == {1: True, 2: False, 3: False, None: True}
    assert {m for m, _, _ in THRESHOLDS} <= set(measure(make_docs([])).columns)


def test_empty_and_clashing_columns(make_docs):
    docs = make_docs([(1, "a b")]).withColumn("w", F.lit(1)).withColumn("t", F.lit("q"))
    assert quality(docs).first().n_words == 2
    assert quality(make_docs([])).count() == 0
