import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import simhash
from docweave.llm.components import components


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(pairs_of):
    """vertex -> smallest vertex reachable, by repeated passes over all pairs."""
    root = {v: v for v in pairs_of}
    changed = True
    while changed:
        changed = False
        for v, near in pairs_of.items():
            low = min(root[x] for x in near | {v})
            for x in near | {v}:
                if root[x] != low:
                    root[x], changed = low, True
    return root


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute_components(fps):
    vs = sorted(set(fps))
    return brute_roots({a: {b for b in vs if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4} for a in vs})


def make_fps(rng, n_balls, ball, n_random):
    out = []
    for _ in range(n_balls):
        c = rng.getrandbits(64)
        for _ in range(ball):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.append(signed(x))
    return out + [signed(rng.getrandbits(64)) for _ in range(n_random)]


def test_fingerprint_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n", "A b", "a B C", "é \x85 ß a b", "x " * 40]
    texts += [" ".join(rng.choices(["aa", "Bb", "cé", "d."], k=rng.randint(1, 60))) for _ in range(50)]
    texts.append(" ".join(rng.choices("abcdefghij", k=20000)))
    for t in texts:
        assert simhash.fingerprint(t) == signed(brute_fp(t))


def test_gray_index_search_is_exact():
    rng = random.Random(4)
    f = np.unique(np.array(make_fps(rng, 5, 60, 300), np.int64))
    f = f[np.argsort(simhash.gray_rank_np(f))]
    for d in (0, 3, 4, 8):
        q, t = simhash.GrayIndex(f).search(f[:100], d)
        want = {(i, j) for i in range(100) for j in range(len(f)) if int(f[i] ^ f[j]) & ((1 << 64) - 1) >= 0
                and (int(f[i] ^ f[j]) & ((1 << 64) - 1)).bit_count() <= d}
        assert set(zip(q.tolist(), t.tolist())) == want


def test_upper_nodes_prune_whole_groups():
    rng = random.Random(7)
    f = np.unique(np.array(make_fps(rng, 3, 40, 16_000), np.int64))
    f = f[np.argsort(simhash.gray_rank_np(f))]
    index = simhash.GrayIndex(f)
    assert len(index.levels) >= 3
    index.search(f[:200], 4)
    assert index.pruned > 200 and index.compared < 0.6 * 200 * len(f)


def test_blocks_are_chosen_by_the_number_of_fingerprints():
    assert [simhash.kept_blocks(n, 4) for n in (0, 10_000, 16_385, 10**8, 10**9, 10**11)] == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("members", [16_384, 16, 1e-2])
@pytest.mark.parametrize("leaf", [4, 16, 2048])
def test_links_keep_components_at_any_leaf_size(spark, monkeypatch, leaf, members):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash.kept_blocks, "__defaults__", (members,))
    rng = random.Random(leaf)
    fps = sorted(set(make_fps(rng, 4, 60, 200)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5)
    got = {r.vertex: r.root for r in components(simhash.fingerprint_links(df)).collect()}
    want = brute_components(fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_on_paths_stars_and_cycles(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)]
    pairs += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (7, 6)]
    rng.shuffle(pairs)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    assert got == {v: r for v, r in brute_roots(near).items() if v != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_form_and_stage(make_docs):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    rows = [(50 - i, " ".join(base[:i] + [f"z{i}"] + base[i + 1:])) for i in range(20)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "only this"), (104, "ONLY this"),
             (105, "q " * 3000), (105, "q " * 3000), (None, "alone in here")]
    docs = make_docs(rows).withColumn("fp", F.lit(1)).withColumn("id", F.lit(2))
    out = simhash.near_dedup(docs).collect()
    assert len(out) == len(rows)
    comp = {r.doc_id: r.component_id for r in out}
    text = {i: t for i, t in rows}
    fp = {i: brute_fp(t) for i, t in rows if i is not None}
    want = brute_components([signed(f) for f in fp.values()])
    low = {}
    for i, f in fp.items():
        low[want[signed(f)]] = min(i, low.get(want[signed(f)], i))
    for i, f in fp.items():
        assert comp[i] == low[want[signed(f)]], text[i]
    assert comp[None] is None and comp[101] == 100 and comp[104] == 103
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" for r in out if r.doc_id is not None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == sorted({*low.values(), -1})
    assert simhash.near_dedup(make_docs([])).count() == 0
