import hashlib
import random

from docweave.llm import line_dedup as ld
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, min_docs=10, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in doc] for doc in lines]
    docs = {}
    for doc in keys:
        for k in set(doc):
            docs[k] = docs.get(k, 0) + 1
    out = []
    for doc, ks in zip(lines, keys):
        kept = [x for x, k in zip(doc, ks) if len(k) < min_chars or docs[k] < min_docs]
        out.append((len(doc), len(doc) - len(kept), "\n".join(kept)))
    return out


def texts(n=120, seed=1):
    rng = random.Random(seed)
    common = ["Menu", " menu\t", "MENU", "É", "é", "\x85x", "", "  ", "a b", "Share this!"]
    found = [None, "", "\n", "\n\n", "menu"]
    for i in range(n):
        found.append("\n".join(rng.choice(common + [f"own {i}", f"rare {i % 15}"])
                               for _ in range(rng.randint(1, 12))))
    return found


def run(make_docs, rows, **how):
    return [(r.n_lines, r.n_dropped, r.text) for r in
            ld.dedup_lines(make_docs(rows), **how).orderBy("doc_id").collect()]


def test_against_brute_force(make_docs):
    t = texts()
    assert run(make_docs, list(enumerate(t))) == brute(t)
    assert run(make_docs, list(enumerate(t)), min_docs=3, min_chars=4) == brute(t, 3, 4)


def test_no_line_broadcast_gives_the_same(make_docs):
    t = texts(seed=2)
    assert run(make_docs, list(enumerate(t)), heavy_keys=1) == brute(t)


def test_repeated_rows_and_null_ids(make_docs):
    rows = [(None, "x\ny")] * 9 + [(5, "x\nz")]
    got = sorted(tuple(r) for r in ld.dedup_lines(make_docs(rows)).select("text", "n_dropped").collect())
    assert got == [("y", 1)] * 9 + [("z", 1)]
    assert {r.text for r in ld.dedup_lines(make_docs(rows[1:])).collect()} == {"x\ny", "x\nz"}


def test_very_long_text(make_docs):
    long = "\n".join(f"line {i}" if i % 3 else "again" for i in range(200_000))
    rows = [(0, long)] + [(i, "again") for i in range(1, 10)]
    assert run(make_docs, rows) == brute([t for _, t in rows])


def test_empty_table_and_clashing_columns(make_docs):
    assert ld.dedup_lines(make_docs([])).count() == 0
    docs = make_docs([(1, "a\nb")]).withColumn("k1", F.lit(1)).withColumn("Lines", F.lit("q"))
    r = ld.dedup_lines(docs).first()
    assert tuple(r) == (1, 2, 0, "a\nb")
    assert hashlib.sha256(b"a\nb").hexdigest() == ld.dedup_lines(docs).select(F.sha2("text", 256)).first()[0]
